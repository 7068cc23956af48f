"""Benchmark decontamination with one Aho-Corasick automaton over the benchmark's word windows."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid.llm.common import arrow_map, cut, kept, texts, union_all

#: ASCII letters in lower case, digits and every byte of a non-ASCII character are kept; the rest
#: separates words.
_NORMAL = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32
    for c in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")

HITS = "hits array<int>, items array<string>, spans array<struct<start:int,end:int>>"


def normalise(text: bytes) -> list[bytes]:
    """Words of a text: letters A-Z in lower case, ASCII punctuation and space left out."""
    return text.translate(_NORMAL).split()


#: Windows of one automaton (about 900 bytes each).
MOST_WINDOWS = 500_000
#: A word's number is written with two letters, a first of these many and a second from there on: the
#: automaton looks for a node's next letter among its letters one by one, so they must be few.
_FIRST = 512
_PLACES = "array<struct<at:int,start:int,end:int>>"


class Matcher:
    """Aho-Corasick automaton over the word windows of ``items``. A whole word is two letters, so a
    window of ten words costs at most twenty nodes, however long its words are; an item of fewer
    than ``width`` words is one window."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        self.letter: dict[bytes, str] = {}
        found: dict[str, tuple[str, ...]] = {}
        same: dict[tuple, tuple] = {}  # equal values are one object
        for item, text in items:
            words = normalise(text)
            for w in words:
                if w not in self.letter:
                    high, low = divmod(len(self.letter), _FIRST)
                    self.letter[w] = chr(1 + low) + chr(1 + _FIRST + high)
            line = "".join(map(self.letter.__getitem__, words))
            for i in range(max(1, len(words) - width + 1) if words else 0):
                window = line[2 * i : 2 * (i + width)]
                ids = found.get(window, ())
                if item not in ids:
                    ids = (*ids, item)
                    found[window] = same.setdefault(ids, ids)
        self.built = ahocorasick.Automaton()
        while found:
            window, ids = found.popitem()
            value = (len(window) // 2, ids)
            self.built.add_word(window, same.setdefault(value, value))
        if len(self.built):
            self.built.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words lie inside an occurrence of a window, and the ids of the items concerned."""
        hit, items = np.zeros(len(words), bool), set()
        if words and len(self.built):
            letter = self.letter.get
            line = "".join([letter(w, "\0\0") for w in words])
            for at, (count, ids) in self.built.iter(line):
                last = at // 2
                hit[last - count + 1 : last + 1] = True
                items.update(ids)
        return hit, items


@kept
def _matcher(shared) -> Matcher:
    """The automaton of a block, built once by a Python worker for all its tasks."""
    return Matcher(*shared.value)


def places(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Number and range (code points, end exclusive) of each hit word."""
    if not hit.any():
        return []
    return [
        {"at": k, "start": m.start(), "end": m.end()}
        for k, m in enumerate(_WORD.finditer(text)) if hit[k]
    ]


def spans(words: list[dict[str, int]]) -> list[dict[str, int]]:
    """Ranges from the first to the last word of each run of neighbouring words."""
    found: list[dict[str, int]] = []
    before = None
    for w in words:
        if before is not None and w["at"] == before + 1:
            found[-1]["end"] = w["end"]
        else:
            found.append({"start": w["start"], "end": w["end"]})
        before = w["at"]
    return found


def _pieces(benchmark: DataFrame, width: int, most: int) -> DataFrame:
    """Rows (item, words, n): items in pieces of at most about ``most`` windows, neighbours sharing
    ``width`` - 1 words so that no window is lost and none is added."""
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"({_WORD.pattern})"), F.lit(1))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(
        "item is not null and size(w) > 0"
    )
    return items.selectExpr(
        "item", f"explode(sequence(0, greatest(0, size(w) - {width}), {most})) as at", "w"
    ).selectExpr("item", f"slice(w, at + 1, {most + width - 1}) as w").selectExpr(
        "item", "concat_ws(' ', w) as words", "size(w) as n"
    )


def _blocks(benchmark: DataFrame, width: int, limit: int) -> list[DataFrame]:
    """The benchmark in blocks of at most about ``limit`` windows; one, unless it holds more."""
    limit = min(limit, MOST_WINDOWS)
    pieces = _pieces(benchmark, width, max(1, limit // 16))
    total = pieces.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if total <= limit:
        return [pieces]
    n = -(-3 * total // (2 * limit))  # hashing leaves some blocks fuller than others
    pieces = cut(pieces.withColumn("block", F.pmod(F.xxhash64("item", "words"), F.lit(n))), "benchmark")
    return [pieces.where(F.col("block") == k) for k in range(n)]


def _share(spark: SparkSession, block: DataFrame, width: int):
    """A block's pieces, sent to the tasks (its size is bounded by the block's windows)."""
    rows = [(r["item"], r["words"].encode()) for r in block.select("item", "words").collect()]
    return spark.sparkContext.broadcast((rows, width))


_PLACE = pa.struct({"at": pa.int32(), "start": pa.int32(), "end": pa.int32()})
_SPAN = pa.struct({"start": pa.int32(), "end": pa.int32()})
_HITS = pa.schema(
    {"doc_id": pa.int64(), "text_sha": pa.binary(), "items": pa.list_(pa.string()), "places": pa.list_(_PLACE)}
)
_FOUND = pa.schema(
    {
        "doc_id": pa.int64(), "n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(),
        "items": pa.list_(pa.string()), "spans": pa.list_(_SPAN),
    }
)
_FOUND_SQL = (
    "doc_id long, n_words long, n_hit long, n_items long, items array<string>, spans array<struct<start:int,end:int>>"
)


def _scanned(docs: DataFrame, shared, row, schema: pa.Schema, sql: str) -> DataFrame:
    """What ``row(doc_id, text, hit words, item ids)`` gives of each document for one block; rows of
    ``schema``, none where it gives None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                made = row(doc, text, *matcher.scan(normalise(text)))
                if made is not None:
                    rows.append(made)
            columns = list(zip(*rows)) or [()] * len(schema)
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return docs.mapInArrow(run, sql)


def _whole_row(doc, text: bytes, hit: np.ndarray, ids: set[str]) -> tuple:
    runs = spans(places(text.decode(), hit)) if ids else []
    return doc, len(hit), int(np.count_nonzero(hit)), len(ids), sorted(ids), runs


def _hit_row(doc, text: bytes, hit: np.ndarray, ids: set[str]) -> tuple | None:
    return (doc, hashlib.sha256(text).digest(), sorted(ids), places(text.decode(), hit)) if ids else None


def _key() -> Column:
    """SHA-256 of the text, null as empty."""
    return F.unhex(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256))


def _passes(docs: DataFrame, blocks: list[DataFrame], width: int) -> DataFrame:
    """Hits of several blocks, one row per different (doc_id, text) that has any: a job per block, each
    with one automaton in a worker's memory, each written with the hit documents only."""
    found = []
    for block in blocks:
        shared = _share(docs.sparkSession, block, width)
        part = _scanned(
            docs, shared, _hit_row, _HITS, f"doc_id long, text_sha binary, items array<string>, places {_PLACES}"
        )
        # copies of a row give the same: one of each leaves a task
        part = part.groupBy("doc_id", "text_sha").agg(F.first("items").alias("items"), F.first("places").alias("places"))
        found.append(cut(part, "hits"))
        shared.destroy()
    return union_all(found).groupBy("doc_id", "text_sha").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
    )


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = MOST_WINDOWS
) -> DataFrame:
    """Scan ``docs`` (doc_id, text) once for windows of ``width`` words of ``benchmark`` (item_id,
    text): rows (doc_id, n_words, n_hit, n_items, items, spans).

    ``items`` are the ids as text, sorted; ``spans`` lie in the original text, in code points. One
    automaton serves a benchmark of at most ``limit`` windows, counted first. A larger one is
    scanned in blocks of about that size, one job after the other, so no worker holds more than
    one block; long items are cut in pieces. Their hits are united by document and text.
    Null and empty texts have no words; items without words or id have no windows; an empty
    benchmark hits nothing. Repeated rows each have their row. Other columns are ignored.
    """
    plain = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    blocks = _blocks(benchmark, width, limit)
    if len(blocks) == 1:
        shared = _share(docs.sparkSession, blocks[0], width)
        return _scanned(plain, shared, _whole_row, _FOUND, _FOUND_SQL)
    hits = _passes(plain, blocks, width).withColumnRenamed("doc_id", "_doc").withColumnRenamed("text_sha", "_sha")
    words = F.regexp_count("text", F.lit(_WORD.pattern))
    every = plain.select("doc_id", _key().alias("text_sha"), F.coalesce(words, F.lit(0)).cast("long").alias("n_words"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("text_sha") == F.col("_sha"))
    joined = every.join(hits, same, "left").select(
        "doc_id", "n_words",
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("places", F.array().cast(_PLACES)).alias("places"),
    )

    def final(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [
            (doc, n, len(at), len(ids), ids, spans(at))
            for doc, n, ids, at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_words", "items", "places")))
        ]
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _FOUND)], schema=_FOUND)

    return arrow_map(joined, final, _FOUND_SQL)


def digest(items: list[str]) -> str:
    """Lowercase hex SHA-256 of the sorted ids, comma-joined."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = MOST_WINDOWS
) -> DataFrame:
    """``docs`` without the rows that hold a window of ``benchmark``; rows that repeat an id with
    another text are judged by their own text, rows without a doc_id as well. A benchmark of more than
    ``limit`` windows is scanned in blocks, and rows with a hit are taken out by their text."""
    blocks = _blocks(benchmark, width, limit)
    if len(blocks) > 1:
        plain = docs.select(F.lit(None).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        bad = _passes(plain, blocks, width).select(F.col("text_sha").alias("_bad_sha"))
        return docs.join(bad, _key() == F.col("_bad_sha"), "left_anti")
    shared = _share(docs.sparkSession, blocks[0], width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = _matcher(shared)
        for batch in batches:
            clean = [not matcher.scan(normalise(t))[1] for t in texts(batch.column("text"))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)

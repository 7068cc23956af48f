"""Sequence packing as a cutting-stock problem solved by column generation.

Pieces are counted by length class. A linear program chooses how often each cutting pattern (how
many pieces of which classes share a sequence) is used; new patterns are priced by a knapsack
dynamic program; the rounded pattern counts are then dealt to the pieces by their rank in the class.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm.common import cut, kept, texts

#: Set between words that are encoded together: lower-cased words cannot hold it.
BORDER = "A"
#: Words that normalisation only lower-cases: they compose with nothing and hold no white space.
PLAIN = re.compile("[\x21-\x7EÀ-ÖØ-öø-ÿ]+")
PLAIN_LINE = re.compile("[\x20-\x7EÀ-ÖØ-öø-ÿ]+")
#: Marks that end many words; where the tokenizer treats them apart, what is before is encoded once.
MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordTokens:
    """Token ids of a text, word by word: the tokenizer treats parts between ASCII white space
    apart from each other, so a part's ids are remembered. Those of the latest ``keep`` parts are
    always kept; when more are held, the older half goes."""

    def __init__(self, tokenizer: str, keep: int = 400_000):
        import public_tokenizers
        from tokenizers import Tokenizer

        path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
        self.coder, self.keep = Tokenizer.from_file(path), keep
        self.special = [t.content for t in self.coder.get_added_tokens_decoder().values()]
        # plain words come in lower case, so they need no normaliser, which is the slowest part
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = None
        lowers = self.coder.normalizer and self.coder.normalizer.normalize_str("Aß") == "aß"
        ids = self.plain.encode(BORDER, add_special_tokens=False).ids
        self.border = ids[0] if lowers and len(ids) == 1 else None
        self.marks = MARKS if self._marks_apart() else b""
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _marks_apart(self) -> bool:
        """Whether a word's last marks are tokenised apart from the letter or digit before them."""
        split = self.plain.pre_tokenizer
        return split is not None and all(
            [at for _, at in split.pre_tokenize_str(c + run)] == [(0, 1), (1, 1 + len(run))]
            for c in "aé1" for run in (MARKS.decode(), MARKS.decode()[::-1], *map(chr, MARKS))
        )

    def learn(self, words: Iterable[bytes]) -> None:
        """Remember all of ``words``. Plain ones not remembered yet are encoded in one text."""
        fresh = []
        for w in set(words).difference(self.new):
            if (ids := self.old.get(w)) is None:
                fresh.append(w)
            else:
                self.new[w] = ids
        plain, other = self._sort_out(fresh)
        # ids are kept as bytes: millions of tuples would keep Python's collector busy
        for w in other:
            ids = self.coder.encode(w.decode(), add_special_tokens=False).ids
            self.new[w] = np.array(ids, "<u4").tobytes()
        if plain:
            lower = b" ".join(plain).decode().lower().encode().split(b" ")
            heads = [w.rstrip(self.marks) for w in lower] if self.marks else lower
            tails = [w[len(h) :] for w, h in zip(lower, heads)]
            self._encode(set(heads).union(tails).difference(self.new))
            known = self.new
            for w, h, t in zip(plain, heads, tails):
                known[w] = known[h] + known[t]

    def _sort_out(self, words: list[bytes]) -> tuple[list[bytes], list[bytes]]:
        """Plain words without a special token, and all others."""
        if self.border is None:
            return [], words
        line = b" ".join(words).decode()
        special = [t for t in self.special if t in line]
        if not special and PLAIN_LINE.fullmatch(line):
            return words, []
        plain, other = [], []
        for w in words:
            word = w.decode()
            fits = PLAIN.fullmatch(word) and not any(t in word for t in special)
            (plain if fits else other).append(w)
        return plain, other

    def _encode(self, parts: set[bytes]) -> None:
        """Remember lower-case plain parts of words."""
        self.new[b""] = b""
        if some := list(parts - {b""}):
            line = f" {BORDER} ".encode().join(some).decode()
            got = np.array(self.plain.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
            ends = [*np.flatnonzero(got == self.border).tolist(), len(got)]
            raw, a = got.tobytes(), 0
            for part, b in zip(some, ends, strict=True):
                self.new[part] = raw[4 * a : 4 * b]
                a = b + 1

    def all(self, many: Iterator[bytes], together: int = 1 << 20) -> Iterator[np.ndarray]:
        """Ids of many texts; new words of about ``together`` bytes of text are encoded at once."""
        held, size = [], 0
        for text in many:
            held.append(text)
            size += len(text)
            if size >= together:
                yield from self._some(held, size)
                held, size = [], 0
        yield from self._some(held, size)

    def _some(self, held: list[bytes], size: int) -> Iterator[np.ndarray]:
        if size > 1 << 23:  # longer texts learn by parts
            yield from map(self, held)
            return
        split = [text.split() for text in held]
        self._turn()
        self.learn(chain.from_iterable(split))
        known = self.new.__getitem__
        for words in split:
            yield np.frombuffer(b"".join(map(known, words)), "<u4")

    def _turn(self) -> None:
        if len(self.new) > self.keep:
            self.new, self.old = {}, self.new

    def __call__(self, text: bytes) -> np.ndarray:
        words, ids = text.split(), []
        for i in range(0, len(words), self.keep):
            part = words[i : i + self.keep]
            self._turn()
            self.learn(part)
            ids.append(b"".join(map(self.new.__getitem__, part)))
        return np.frombuffer(b"".join(ids), "<u4")


@kept
def word_tokens(tokenizer: str) -> WordTokens:
    """The tokenizer of a Python worker, with the words it remembers: its later tasks use both."""
    return WordTokens(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """Tokenised documents cut into pieces of ``capacity`` tokens and a rest: rows ``PIECES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_tokens(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, found in zip(batch.column("doc_id").to_pylist(), encode.all(texts(batch.column("text")))):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for a in range(0, len(ids), capacity):
                    part = ids[a : a + capacity]
                    rows.append((doc, a, len(part), zlib.crc32(part.tobytes()), len(ids)))
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=names)

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return picked.mapInArrow(run, PIECES)


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Most valuable multiset of classes that fits: its value and how many of each."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    s, v = sizes[order], values[order]
    for c in range(1, capacity + 1):
        n = int(np.searchsorted(s, c, "right"))
        best[c] = best[c - 1]
        if n:
            options = best[c - s[:n]] + v[:n]
            k = int(np.argmax(options))
            if options[k] > best[c] + 1e-12:
                best[c], taken[c] = options[k], k
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            counts[order[taken[c]]] += 1
            c -= int(s[taken[c]])
    return float(best[capacity]), counts


def column_generation(
    sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 3000, gap: float = 1e-2
) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows: pieces of each class) and how often each is used (real numbers) in the linear
    program that covers ``demand`` with fewest sequences, by revised simplex. Ends when no pattern
    can lower the total by more than ``gap`` of it, or after ``rounds`` pivots."""
    m = len(sizes)
    base = np.diag(np.maximum(1, capacity // sizes)).astype(float)  # columns: patterns in the basis
    inverse, use = np.diag(1.0 / np.diag(base)), demand / np.diag(base)
    for t in range(rounds):
        prices = inverse.sum(axis=0)  # every pattern costs one sequence
        value, counts = knapsack(np.maximum(prices, 0), sizes, capacity)
        if value <= 1 + gap:
            break
        column = inverse @ counts
        ratio = np.where(column > 1e-9, use / np.where(column > 1e-9, column, 1), np.inf)
        out = int(np.argmin(ratio))
        if not np.isfinite(ratio[out]):
            break
        base[:, out] = counts
        if t % 200 == 199:
            inverse = np.linalg.inv(base)
            use = np.maximum(inverse @ demand, 0)
        else:
            pivot = inverse[out] / column[out]
            inverse -= np.outer(column, pivot)
            inverse[out] = pivot
            step = use[out] / column[out]
            use = np.maximum(use - step * column, 0)
            use[out] = step
    return base.T.astype(np.int64), use


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns and their numbers that use every piece exactly once: the rounded-down linear
    program, then best fit of what is left, longest first."""
    if not len(sizes):
        return []
    patterns, use = column_generation(sizes, demand.astype(float), capacity)
    left, out = demand.copy(), []
    for p, n in zip(patterns, np.floor(use + 1e-9).astype(np.int64)):
        n = min([int(n), *(int(left[c] // p[c]) for c in np.flatnonzero(p))])
        if n > 0:
            out.append((p.copy(), n))
            left -= n * p
    while left.any():
        room, p = capacity, np.zeros(len(sizes), np.int64)
        for c in np.argsort(-sizes, kind="stable"):
            n = min(int(left[c]), int(room // sizes[c]))
            p[c] += n
            room -= n * int(sizes[c])
        used = np.flatnonzero(p)
        n = int(min(left[used] // p[used]))
        out.append((p, n))
        left -= n * p
    return out


def pack(
    docs: DataFrame,
    tokenizer: str = "word_bpe_49k.json",
    capacity: int = 4096,
    end_id: int = 2,
    unit: int = 16,
    buckets: int | None = None,
) -> DataFrame:
    """Pack every row of ``docs`` (doc_id, text) into sequences of at most ``capacity`` tokens: rows
    ``PIECES`` with sequence_id and offset.

    A document is its ids and ``end_id``; what exceeds ``capacity`` is cut into full sequences and a
    rest, and rests are packed whole. Lengths are rounded up to multiples of ``unit`` tokens for
    the program, and pieces of equal length up to four units are bundled to about four units, so the
    driver sees about ``capacity / unit`` counts whatever the input's size. Pieces of a
    class are numbered in ``buckets`` by the hash of their document, so that no length, however
    common, is ranked in one task. Null and empty texts are one token; repeated rows are packed
    each; a null doc_id is carried along. No rows: no rows.
    """
    spark = docs.sparkSession
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cutter = cut(pieces(docs, tokenizer, capacity, end_id), "pieces")
    bundle = 4 * unit
    spread = cutter.withColumn(
        "class",
        F.when(F.col("length") <= bundle, F.col("length"))
        .otherwise(F.ceil(F.col("length") / unit) * unit)
        .cast("int"),
    ).withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int")
    )
    sums = spread.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut(sums.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-counts")
    totals = {r["class"]: r["n"] for r in starts.groupBy("class").agg(F.sum("n").alias("n")).collect()}
    classes = sorted(totals)
    together = [max(1, bundle // c) for c in classes]
    sizes = np.array([-(-c * g // unit) for c, g in zip(classes, together)], np.int64)
    demand = np.array([-(-totals[c] // g) for c, g in zip(classes, together)], np.int64)

    rows, seen, sequences = [], [0] * len(classes), 0
    for p, n in plan(sizes, demand, capacity // unit):
        for k in np.flatnonzero(p).tolist():
            each = int(p[k]) * together[k]
            rows.append((classes[k], seen[k], seen[k] + n * each, each, sequences))
            seen[k] += n * each
        sequences += n
    lots = spark.createDataFrame(rows, "class int, first long, last long, each long, base long")

    own = Window.partitionBy("class", "bucket").orderBy("doc_id", "start", "ids_crc32")
    ranked = spread.withColumn("in", F.row_number().over(own) - 1).join(
        starts.select("class", "bucket", "before"), ["class", "bucket"]
    ).withColumn("rank", F.col("before") + F.col("in"))
    # A class has few lots (patterns that use it); they are found by search in its sorted bounds.
    by_class = lots.groupBy("class").agg(
        F.sort_array(F.collect_list(F.struct("last", "first", "each", "base"))).alias("lots")
    )
    placed = (
        ranked.join(F.broadcast(by_class), "class")
        .withColumn("lot", F.expr("element_at(filter(lots, x -> x.last > rank), 1)"))
        .withColumn("at", F.col("rank") - F.col("lot.first"))
        .withColumn("sequence_id", F.col("lot.base") + F.floor(F.col("at") / F.col("lot.each")))
        .drop("lots", "lot", "at")
    )
    inside = Window.partitionBy("sequence_id").orderBy(
        F.desc("length"), "doc_id", "start", "ids_crc32", "rank"
    ).rowsBetween(Window.unboundedPreceding, -1)
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(inside), F.lit(0)).alias("offset"),
    )

"""Near-duplicate texts by their word shingles: every pair of Jaccard similarity 0.8 or more.

Two such sets share one of the first fifth of their shingles in any common order (prefix filter), so
an equality join on those finds every pair; none is left to chance. The order puts rare shingles
first, which keeps the lists of a key short: how often a shingle occurs is read off a table of fixed
size, and a cell shared by several shingles costs longer lists only. Candidates are verified on their
whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.llm import simhash
from pulsegrid.llm.common import LOWER, components, cut, forget, release, texts

#: Similarity that makes two texts near-duplicates, as a fraction.
SAME, OF = 4, 5
_CELLS = 1 << 20
_MARK = 1024


def shingles(text: bytes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the different word shingles of a text; a shorter text is one shingle."""
    words = text.translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(1, len(words) - width + 1)
    starts = np.concatenate([[0], ends[: n - 1] + 1]).tolist()
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[i:j]) for i, j in zip(starts, stops)), np.uint64, n))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SAME * (len(a) + len(b) - both)


def _text_hash() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def _sets(column: pa.Array) -> Iterator[np.ndarray]:
    for value in column:
        yield np.frombuffer(value.as_py(), np.uint64)


def _slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``most`` bytes of a text or binary column each."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = np.cumsum(size) // most
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def prints(docs: DataFrame, width: int = 5) -> DataFrame:
    """(doc_id, th, fp, sig, grams) per row: a hash of the text, its SimHash, a hash that names the
    shingle set, and the set; a task gives a set once and null for its further copies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        seen: set[int] = set()
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        for batch in (part for whole in batches for part in _slices(whole, "text")):
            fps, sigs, sets = [], [], []
            for text in texts(batch.column("text")):
                fps.append(simhash.fingerprint(text))
                own = shingles(text, width).tobytes()
                sigs.append(xxhash.xxh64_intdigest(own))
                sets.append(None if sigs[-1] in seen else own)
                seen.add(sigs[-1])
            yield pa.record_batch(
                {"doc_id": batch.column("doc_id"), "th": batch.column("th"), "fp": signed(fps), "sig": signed(sigs), "grams": pa.array(sets, pa.binary())}
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    picked = picked.withColumn("th", _text_hash())
    return picked.mapInArrow(run, "doc_id long, th long, fp long, sig long, grams binary")


def _commonness(sets: DataFrame) -> np.ndarray:
    """Logarithm of the count in the cells of shingles that have four times the mean, 0 in the others;
    a quarter of the cells at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_CELLS, np.int64)
        for batch in batches:
            for s in _sets(batch.column("grams")):
                np.add.at(n, (s % np.uint64(_CELLS)).astype(np.int64), 1)
        some = np.flatnonzero(n)
        for at in range(0, len(some), 1 << 16):
            part = some[at : at + (1 << 16)]
            yield pa.record_batch({"cell": pa.array(part.astype(np.int32)), "n": pa.array(n[part])})

    counted = cut(
        sets.select("grams").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")), "shingle-cells"
    )
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = counted.where(F.col("n") >= max(8, 4 * total // _CELLS))
    found = often.select(F.col("cell").cast("int").alias("cell"), F.floor(F.log2("n")).cast("byte").alias("level")).toPandas()
    levels = np.zeros(_CELLS, np.uint8)
    levels[found["cell"].to_numpy(np.int64)] = found["level"].to_numpy(np.uint8)
    return levels


def _plain(column: pa.Array) -> np.ndarray:
    """Values of a number column; of a column of equally long binaries, their 64-bit words by row."""
    if not pa.types.is_binary(column.type):
        return column.to_numpy()
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset :]
    raw = np.frombuffer(column.buffers()[2], np.uint8)[at[0] : at[len(column)]]
    return raw.reshape(len(column), -1).view(np.uint64)


def _runs(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[np.ndarray]]:
    """Whole runs of rows of one key, many at once, from batches sorted by key (the first column)."""
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        part = [_plain(batch.column(c)) for c in columns]
        whole = int(np.searchsorted(part[0], part[0][-1]))  # the last key may go on
        if held and rows + whole >= 1 << 16 and (whole or held[-1][0][-1] != part[0][0]):
            held.append([c[:whole] for c in part])
            yield [np.concatenate(c) for c in zip(*held)]
            held, rows, part = [], 0, [c[whole:] for c in part]
        held.append(part)
        rows += len(part[0])
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def shared_keys(sets: DataFrame) -> DataFrame:
    """(key, sig, n, pos): the first shingles of each set that another set has among its first too;
    ``pos`` is the place in the common order, ``n`` the set's size."""
    levels = sets.sparkSession.sparkContext.broadcast(_commonness(sets))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        for batch in (part for whole in batches for part in _slices(whole, "grams")):
            keys, sizes, places = [], [], []
            for s in _sets(batch.column("grams")):
                first = len(s) - -(-SAME * len(s) // OF) + 1 if len(s) else 0
                order = np.argsort(level[(s % np.uint64(_CELLS)).astype(np.int64)], kind="stable")
                keys.append(s[order[:first]])
                sizes.append(len(s))
                places.append(np.arange(first, dtype=np.int32))
            each = [len(k) for k in keys]
            yield pa.record_batch(
                {
                    "key": pa.array(np.concatenate(keys).view(np.int64)),
                    "sig": pa.array(np.repeat(batch.column("sig").to_numpy(), each)),
                    "n": pa.array(np.repeat(np.array(sizes, np.int32), each)),
                    "pos": pa.array(np.concatenate(places)),
                }
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sig, n, pos in _runs(batches, ["key", "sig", "n", "pos"]):
            # copies of a text have equal rows, next to each other
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])])
            key, sig, n, pos = key[new], sig[new], n[new], pos[new]
            same = np.concatenate([[False], key[1:] == key[:-1], [False]])
            some = same[1:] | same[:-1]
            yield pa.record_batch({"key": pa.array(key[some]), "sig": pa.array(sig[some]), "n": pa.array(n[some]), "pos": pa.array(pos[some])})

    schema = "key long, sig long, n int, pos int"
    keyed = sets.select("sig", "grams").mapInArrow(spread, schema)
    return keyed.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(run, schema)


def candidates(keys: DataFrame, star: bool) -> DataFrame:
    """Different pairs (a, b) of ``keys`` (key, sig, n, pos, component) that share a key, are in two
    components and whose sizes and places allow the similarity: with ``star`` those with the first of
    each key by a further column ``turn``; else all whose marks (further column ``mark``) allow it too, so that a crowd that shares
    a passage and little else is told apart in place and leaves few pairs."""
    columns = ["key", "sig", "n", "pos", "component"] + ([] if star else ["mark"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, sig, n, pos, group, *mark in _runs(batches, columns):
            starts = np.searchsorted(key, key)
            at, d = np.arange(len(key)), 0
            while len(at):
                d += 1
                if star:
                    i, j, at = starts, at, at[:0]
                else:
                    at = at[at + d < len(key)]
                    at = at[key[at] == key[at + d]]
                    i, j = at, at + d
                most = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j]).astype(np.int64)
                fits = (group[i] != group[j]) & ((SAME + OF) * most >= SAME * (n[i].astype(np.int64) + n[j]))
                i, j = i[fits], j[fits]
                for m in mark:
                    close = _marks_allow(m, n, i, j)
                    i, j = i[close], j[close]
                if len(i):
                    pairs = np.unique(np.sort(np.stack([sig[i], sig[j]], axis=1), axis=1), axis=0)
                    yield pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    order = ["key", "turn", "sig"] if star else ["key", "component", "sig"]
    dealt = keys.repartition("key").sortWithinPartitions(*order)
    return dealt.mapInArrow(run, "a long, b long").distinct()


def parity(s: np.ndarray) -> bytes:
    """A bit for each cell of a table at least as large as the set: whether an odd number of shingles
    fall in it. Tables of two sets differ in no more cells than the sets in shingles."""
    cells = 1 << max(6, (len(s) - 1).bit_length())
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) & (cells - 1), minlength=cells) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def mark(s: np.ndarray) -> bytes:
    """A parity table of :data:`_MARK` cells, whatever the size of the set."""
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) & (_MARK - 1), minlength=_MARK) & 1
    return np.packbits(odd.astype(bool)).tobytes()


def _marks_allow(marks: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the cells in which two marks differ are as few as similar sets of these sizes may have."""
    most = (OF - SAME) * (n[i].astype(np.int64) + n[j])
    out = np.zeros(len(i), bool)
    for a in range(0, len(i), 1 << 15):
        part = slice(a, a + (1 << 15))
        apart = np.bitwise_count(marks[i[part]] ^ marks[j[part]]).sum(axis=1, dtype=np.int64)
        out[part] = (SAME + OF) * apart <= most[part]
    return out


def _apart(x: bytes, y: bytes) -> int:
    """Cells in which two parity tables differ, the larger folded to the size of the smaller."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    m = min(len(a), len(b))
    a, b = (np.bitwise_xor.reduce(t.reshape(-1, m), axis=0) for t in (a, b))
    return int(np.bitwise_count(a ^ b).sum())


def _pairwise(pairs: DataFrame, sets: DataFrame, column: str, kept) -> DataFrame:
    """Those of ``pairs`` for which ``kept(x, y)`` holds of the ``column`` of both sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fits = [kept(x.as_py(), y.as_py()) for x, y in zip(batch.column("x"), batch.column("y"))]
            yield batch.select(["a", "b"]).filter(pa.array(fits, pa.bool_()))

    left = sets.select(F.col("sig").alias("a"), F.col(column).alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col(column).alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def verified(pairs: DataFrame, sets: DataFrame, sketches: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sets have the similarity. Pairs whose parity tables (sig,
    odd) already differ in too many cells are told apart by these, an eighth to a quarter of a
    byte a shingle, and their sets stay where they are."""

    def may(x: bytes, y: bytes) -> bool:
        n = int.from_bytes(x[:8], "little") + int.from_bytes(y[:8], "little")
        return (SAME + OF) * _apart(x[8:], y[8:]) <= (OF - SAME) * n

    def same(x: bytes, y: bytes) -> bool:
        return similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))

    left = cut(_pairwise(pairs, sketches, "odd", may), "shingle-candidates")
    nodes = left.select(F.col("a").alias("sig")).union(left.select("b")).distinct()
    # the whole sets are shuffled only where the cell of their name is that of a candidate; there are
    # 2^20 cells, so what is broadcast has that bound
    cell = F.pmod("sig", F.lit(_CELLS)).cast("int").alias("cell")
    some = sets.select("sig", "grams", cell).join(F.broadcast(nodes.select(cell).distinct()), "cell", "left_semi")
    found = cut(some.select("sig", "grams").join(nodes, "sig", "left_semi").dropDuplicates(["sig"]), "shingle-candidates")
    out = cut(_pairwise(left, found, "grams", same), "shingle-links")
    release(left, found)
    return out


def parities(sets: DataFrame) -> DataFrame:
    """(sig, odd, mark): the size and the parity table of each different set, and its mark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole, "grams")):
            odd = [len(s).to_bytes(8, "little") + parity(s) for s in _sets(batch.column("grams"))]
            marks = [mark(s) for s in _sets(batch.column("grams"))]
            yield pa.record_batch({"sig": batch.column("sig"), "odd": pa.array(odd, pa.binary()), "mark": pa.array(marks, pa.binary())})

    return sets.select("sig", "grams").mapInArrow(run, "sig long, odd binary, mark binary").dropDuplicates(["sig"])


def links(sets: DataFrame, stars: int = 3) -> DataFrame:
    """Edges (a, b) between different sets of ``sets`` (sig, grams) that are similar: not every pair,
    but enough that their components are those of all pairs.

    The first rounds compare every set with one other of its key, in each round another one; only sets
    they have left in different components are compared pair by pair, so a large group of near copies
    costs its members. Any number of rounds gives the same components."""
    keys = cut(shared_keys(sets), "shingle-keys")
    sketches = cut(parities(sets), "shingle-parities")
    rows, seen, found = keys.withColumn("component", F.col("sig")), None, None
    for k in range(stars):
        pairs = candidates(rows.withColumn("turn", F.xxhash64("sig", F.lit(k))), True)
        pairs = cut(pairs if seen is None else pairs.join(seen, ["a", "b"], "left_anti"), "shingle-pairs")
        if found is not None and not pairs.take(1):
            break
        fresh = verified(pairs, sets, sketches)
        found = fresh if found is None else found.unionByName(fresh)
        seen = pairs if seen is None else seen.unionByName(pairs)
        groups = components(found, "shingle-components")
        rows = keys.join(groups.withColumnRenamed("node", "sig"), "sig", "left").withColumn(
            "component", F.coalesce("component", "sig")
        )
        if not fresh.take(1):
            break
    rows = rows.join(sketches.select("sig", "mark"), "sig")
    # what the first rounds have compared is known
    more = cut(candidates(rows, False).join(seen, ["a", "b"], "left_anti"), "shingle-pairs")
    found = found.unionByName(verified(more, sets, sketches))
    release(keys, more, sketches)
    return found


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """Groups of ``docs`` (doc_id, text): rows (doc_id, th, sig, component_id),
    ``th`` a hash of the text.

    Texts are linked if their shingle sets have Jaccard similarity 0.8 or more, or if their
    fingerprints are linked in :mod:`simhash`; ``component_id`` is the smallest doc_id reachable by
    links, null if there is none. Empty and null texts are equal.
    """
    rows = cut(prints(docs, width), "shingles")
    units = cut(rows.groupBy("fp", "sig").agg(F.min("doc_id").alias("least")), "shingle-units")
    fps = cut(units.groupBy("fp").agg(F.min("sig").alias("root")), "simhash-distinct")
    near = cut(simhash.links(fps), "simhash-links")
    a, b = (fps.select(F.col("fp").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    edges = (
        near.join(a, "a").join(b, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        .unionByName(units.join(fps, "fp").select(F.col("sig").alias("a"), F.col("root").alias("b")))
        .unionByName(links(rows.where("grams is not null").select("sig", "grams")))
        .where("a <> b")
    )
    groups = components(edges, "near-components")
    named = units.join(groups, units["sig"] == groups["node"], "left").select(
        "sig", "least", F.coalesce("component", "sig").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.select("sig", "component").distinct().join(least, "component").select("sig", "component_id")
    out = cut(rows.select("doc_id", "th", "sig").join(labels, "sig").select("doc_id", "th", "sig", "component_id"), "near-groups")
    release(rows)
    return out


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group left: the one with the smallest doc_id.

    A row repeated with the same doc_id and text is left once; rows of one doc_id with different texts
    are judged each by its own. No group can be named by a null
    doc_id: such rows are kept, once per text.
    """
    kept = near_duplicates(docs, width).where("doc_id = component_id").select("doc_id", F.col("th").alias("_th")).distinct()
    named = docs.withColumn("_th", _text_hash()).join(kept, ["doc_id", "_th"], "left_semi")
    lone = docs.where("doc_id is null")
    return (
        named.select(*docs.columns)
        .dropDuplicates(["doc_id", "text"])
        .unionByName(lone.dropDuplicates(["text"]))
    )

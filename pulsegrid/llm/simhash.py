"""SimHash near-duplicates through deletion-variant signatures.

A fingerprint is cut into fewer segments than bits may differ, so that two linked fingerprints have
one segment that differs by at most one bit. Each segment is indexed once for each of its bits, with
that bit taken out; linked fingerprints agree in one of these keys, found by an equality join, and
are then verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import LOWER, Forest, arrow_map, components, cut, mix, texts

_SEED = 42


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of the word shingles of a text (UTF-8), repeats counted."""
    words = text.translate(LOWER).split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(b" ".join(words), _SEED)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - shingle] + 1]).tolist()
    stops = ends[shingle - 1 :].tolist()
    hashes = np.fromiter(
        (digest(line[i:j], _SEED) for i, j in zip(starts, stops)), np.uint64, len(starts)
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        part = hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp long) per row of ``docs``. Null and empty texts have fingerprint zero."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t, shingle) for t in texts(batch.column("text"))), np.uint64, batch.num_rows)
        return pa.record_batch({"doc_id": batch.column("doc_id"), "fp": pa.array(fps.view(np.int64))})

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return arrow_map(picked, run, "doc_id long, fp long")


def _segments(bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of the segments: so many that one differs by one bit at most."""
    n = bits // 2 + 1
    edges = [round(64 * i / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variant_keys(fps: np.ndarray, bits: int) -> np.ndarray:
    """One row of keys per fingerprint: every segment with every one of its bits taken out."""
    keys = []
    for k, (low, width) in enumerate(_segments(bits)):
        part = (fps >> np.uint64(low)) & np.uint64((1 << width) - 1)
        for bit in range(width):
            # number of the wildcard above, the segment without the bit below
            keys.append(part & ~np.uint64(1 << bit) | np.uint64((low + bit + 1) << 40))
    return np.stack(keys, axis=1)


def links(distinct: DataFrame, bits: int = 4) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that differ in at most ``bits`` bits: not
    every pair, but enough that their components are those of all pairs.

    Rows of one key are read as a sorted run and compared in numpy, the i-th with the (i+d)-th for
    d = 1, 2, ... over all keys at once; only pairs that join two trees of the task leave it, so a
    crowded key gives as many rows as it has members.
    """

    def spread(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = batch.column("fp").to_numpy().view(np.uint64)
        keys = variant_keys(fps, bits)
        return pa.record_batch(
            {
                "key": pa.array(mix(keys.ravel()).view(np.int64)),
                "fp": pa.array(np.repeat(fps, keys.shape[1]).view(np.int64)),
            }
        )

    def near(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch | None:
        nodes, local = np.unique(fps, return_inverse=True)
        forest, found = Forest(len(nodes)), []
        at, d = np.arange(len(keys)), 0
        while len(at):
            d += 1
            at = at[at + d < len(keys)]
            at = at[keys[at] == keys[at + d]]
            close = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= bits]
            i, j = local[close], local[close + d]
            apart = forest.roots[i] != forest.roots[j]
            if apart.any():
                found += forest.join_all(i[apart], j[apart])
        if not found:
            return None
        pairs = nodes.view(np.int64)[np.array(found)]
        return pa.record_batch({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            keys = np.concatenate([keys, batch.column("key").to_numpy()])
            fps = np.concatenate([fps, batch.column("fp").to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on
            if whole >= 1 << 16:
                if (out := near(keys[:whole], fps[:whole])) is not None:
                    yield out
                keys, fps = keys[whole:], fps[whole:]
        if len(keys) and (out := near(keys, fps)) is not None:
            yield out

    keyed = arrow_map(distinct.select("fp"), spread, "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """Near-duplicate groups of ``docs`` (doc_id, text): rows (doc_id, fp, component_id).

    Fingerprints that differ in at most ``bits`` of 64 bits are linked; ``component_id`` is the
    smallest doc_id reachable by links. Equal fingerprints are collapsed before the search. Empty
    and null texts share fingerprint zero and are linked like any other. Repeated rows stay; a null
    doc_id stays and names a group only if nothing else does (then null). Other columns are ignored.
    No rows: no rows.
    """
    prints = cut(fingerprints(docs, shingle), "simhash")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    edges = cut(links(distinct, bits), "simhash-links")
    groups = components(edges, "simhash-components")
    named = distinct.join(groups, distinct["fp"] == groups["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(least, "component").select("fp", "component_id")
    return prints.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, bits: int = 4, shingle: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate group left: the one with the smallest doc_id.

    A row repeated with the same doc_id and text is left once. No group can be named by a null
    doc_id: such rows are kept, once per text.
    """
    found = near_duplicates(docs, bits, shingle)
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.join(kept, "doc_id", "left_semi")
    lone = docs.where("doc_id is null")
    return (
        named.select(*docs.columns)
        .dropDuplicates(["doc_id", "text"])
        .unionByName(lone.dropDuplicates(["text"]))
    )

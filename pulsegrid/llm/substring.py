"""Removal of word passages that an earlier document holds, by suffix automata.

A broadcast automaton of every reference shard would make the work grow with the square of the
corpus, as every document is reference for all later ones. So shards are cut by content: each word
window belongs to the shard of its anchor, the word group in it with the smallest hash, and the
stretches of documents that share an anchor with another document travel to that shard. There, in
document order, each stretch is streamed through the automaton of the stretches before it; the
matching statistics tell which of its windows an earlier document holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import cut, mix, release, texts


class WordHashes(dict):
    """64-bit hash of a word; remembers the words seen, up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


def anchors(words: list[bytes], known: WordHashes, width: int, gram: int) -> np.ndarray:
    """The anchor of every window of ``width`` words: the smallest hash of its groups of ``gram``
    words."""
    if len(words) < width:
        return np.zeros(0, np.int64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    m = len(words) - gram + 1
    least = np.zeros(m, np.uint64)
    for k in range(gram):
        least = least * np.uint64(0x9E3779B97F4A7C15) + h[k : k + m]
    least, have, span = mix(least), 1, width - gram + 1
    while have < span:  # minimum of so many neighbours, doubled until the window is full
        step = min(have, span - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least.view(np.int64)


def _borders(hashes: np.ndarray) -> np.ndarray:
    """Where a run of equal anchors begins, and the number of windows at the end."""
    change = np.flatnonzero(hashes[1:] != hashes[:-1]) + 1
    return np.concatenate([[0], change, [len(hashes)]])


class SuffixAutomaton:
    """Suffix automaton of word sequences added one by one. ``first`` has, of each state, the
    document that brought it; with documents added in ascending order it is the smallest that holds
    the state's strings."""

    def __init__(self) -> None:
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size, self.first = [-1], [0], [0]

    def _state(self, size: int, link: int, step: dict[bytes, int], doc: int) -> int:
        self.next.append(step)
        self.link.append(link)
        self.size.append(size)
        self.first.append(doc)
        return len(self.size) - 1

    def _split(self, p: int, word: bytes, q: int) -> int:
        """A copy of state ``q`` for the strings of ``p`` followed by ``word``."""
        copy = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]), self.first[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def add(self, words: list[bytes], doc: int) -> None:
        last = 0
        for word in words:
            q = self.next[last].get(word)
            if q is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._split(last, word, q)
                continue
            now = self._state(self.size[last] + 1, 0, {}, doc)
            p = last
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = now
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[now] = q if self.size[q] == self.size[p] + 1 else self._split(p, word, q)
            last = now

    def earlier(self, words: list[bytes], doc: int, width: int) -> list[int]:
        """Starts of the windows of ``width`` words that a document below ``doc`` holds."""
        found, v, length = [], 0, 0
        next_, link, size, first = self.next, self.link, self.size, self.first
        for i, word in enumerate(words):
            while v and word not in next_[v]:
                v = link[v]
                length = size[v]
            to = next_[v].get(word)
            if to is None:
                continue
            v, length = to, length + 1
            if length >= width:
                while size[link[v]] >= width:
                    v = link[v]
                    length = size[v]
                if first[v] < doc:
                    found.append(i - width + 1)
        return found


def _runs(starts: list[int]) -> list[dict[str, int]]:
    """Ascending numbers as runs {off, n}."""
    out: list[dict[str, int]] = []
    for s in starts:
        if out and s == out[-1]["off"] + out[-1]["n"]:
            out[-1]["n"] += 1
        else:
            out.append({"off": s, "n": 1})
    return out


_RUNS = pa.list_(pa.struct({"off": pa.int32(), "n": pa.int32()}))


def _judge(width: int):
    """Stream rows (key, doc, anchor, sh, off, seg) sorted by key and doc through the automaton of
    their key: rows (anchor, sh, runs) with the windows that an earlier document holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, automaton, pending = None, None, None
        for batch in batches:
            runs = []
            for k, doc, off, raw in zip(
                batch.column("key").to_pylist(), batch.column("doc").to_pylist(),
                batch.column("off").to_pylist(), texts(batch.column("seg")),
            ):
                if k != key:
                    key, automaton, pending = k, None, (raw, doc)
                    runs.append([])
                    continue
                if automaton is None:  # built only where a second stretch asks for it
                    automaton = SuffixAutomaton()
                automaton.add(pending[0].split(), pending[1])
                pending = (raw, doc)
                found = automaton.earlier(raw.split(), doc, width)
                runs.append([{"off": r["off"] + off, "n": r["n"]} for r in _runs(found)])
            yield pa.record_batch(
                {"anchor": batch.column("anchor"), "sh": batch.column("sh"), "runs": pa.array(runs, _RUNS)}
            )

    return run


def repeated_passages(
    docs: DataFrame, width: int = 13, gram: int = 6, hot: int = 20_000
) -> DataFrame:
    """Passages of ``docs`` (doc_id, text) that a document with a smaller id holds: rows (doc_id,
    th, spans), th the 64-bit hash of the text and spans an array of (start, n): from word ``start``
    on, ``n`` windows of ``width`` words. Documents without one are not listed.

    An anchor with more than ``hot`` different stretches is split further, its windows going to the
    shard of their own hash, so that no shard's automaton outgrows a task.
    """
    some = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).where("doc_id is not null and text is not null")

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [anchors(t.split(), known, width, gram) for t in texts(batch.column("text"))]
            found = [f[_borders(f)[:-1]] if len(f) else f for f in found]
            ids = np.repeat(batch.column("doc_id").to_numpy(), [len(f) for f in found])
            yield pa.record_batch({"anchor": pa.array(np.concatenate(found)), "doc_id": pa.array(ids)})

    occurs = cut(some.mapInArrow(anchored, "anchor long, doc_id long"), "anchors")
    shared = (
        occurs.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
        .where("a < b").select("anchor")
    )
    marks = cut(
        occurs.join(shared, "anchor", "left_semi").groupBy("doc_id").agg(F.collect_set("anchor").alias("marks")),
        "marks",
    )
    release(occurs)

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            rows: list[tuple] = []
            for doc, th, text, own in zip(
                batch.column("doc_id").to_pylist(), batch.column("th").to_pylist(),
                texts(batch.column("text")), batch.column("marks"),
            ):
                words = text.split()
                hashes = anchors(words, known, width, gram)
                if not len(hashes):
                    continue
                # a stretch: neighbouring windows with one anchor
                edges = _borders(hashes)
                at = np.flatnonzero(np.isin(hashes[edges[:-1]], own.values.to_numpy()))
                for a, b in zip(edges[at].tolist(), edges[at + 1].tolist()):
                    seg = b" ".join(words[a : b - 1 + width])
                    rows.append((doc, th, a, b - a, int(hashes[a]), seg))
            columns = list(zip(*rows)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            arrays[-1] = arrays[-1].cast(pa.string())
            yield pa.record_batch(arrays, names=["doc_id", "th", "start", "n", "anchor", "seg"])

    segs = cut(
        some.withColumn("th", F.xxhash64("text")).join(marks, "doc_id")
        .mapInArrow(stretches, "doc_id long, th long, start int, n int, anchor long, seg string")
        .withColumn("sh", F.xxhash64("seg")),
        "stretches",
    )
    release(marks)
    distinct = cut(
        segs.groupBy("anchor", "seg").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"))
        .withColumn("sh", F.xxhash64("seg")),
        "distinct-stretches",
    )
    crowded = cut(
        distinct.groupBy("anchor").count().where(F.col("count") > hot).select("anchor"), "crowded-anchors"
    )
    columns = ["key", "doc", "anchor", "sh", "off", "seg"]
    by_anchor = distinct.withColumns({"key": F.col("anchor"), "off": F.lit(0)})
    if crowded.isEmpty():
        dealt = by_anchor.select(*columns)
    else:
        by_window = (
            distinct.join(crowded, "anchor", "left_semi")
            .withColumn("off", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
            .withColumn("seg", F.array_join(F.slice(F.split("seg", " "), F.col("off") + 1, width), " "))
            .withColumn("key", F.xxhash64("seg"))
        )
        dealt = by_anchor.join(crowded, "anchor", "left_anti").select(*columns).unionByName(
            by_window.select(*columns)
        )
    dealt = dealt.repartition("key")
    judged = dealt.sortWithinPartitions("key", "doc").mapInArrow(
        _judge(width), "anchor long, sh long, runs array<struct<off:int,n:int>>"
    )
    windows = judged.groupBy("anchor", "sh").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    verdict = cut(
        distinct.select("anchor", "sh", "doc").join(windows, ["anchor", "sh"]), "judged-stretches"
    )
    release(distinct)
    whole = F.array(F.struct(F.lit(0).alias("off"), F.col("n").alias("n")))
    spans = (
        segs.select("doc_id", "th", "start", "n", "anchor", "sh").join(verdict, ["anchor", "sh"])
        # the same stretch in a smaller document covers it all
        .withColumn("runs", F.when(F.col("doc_id") > F.col("doc"), whole).otherwise(F.col("runs")))
        .where(F.size("runs") > 0)
        .select("doc_id", "th", "start", F.explode("runs").alias("run"))
    )
    return spans.groupBy("doc_id", "th").agg(
        F.collect_set(F.struct((F.col("start") + F.col("run.off")).alias("start"), F.col("run.n").alias("n"))).alias("spans")
    )


def remove_repeats(docs: DataFrame, width: int = 13, gram: int = 6, hot: int = 20_000) -> DataFrame:
    """``docs`` (doc_id, text) without the words covered by a window of ``width`` words that also
    starts in a document with a smaller doc_id: rows (doc_id, n_words, n_removed, kept), kept words
    joined by one space.

    Windows are judged on the input, not on what is left. A null text has no words; a null doc_id is
    smaller than none, so such rows neither remove nor lose a word. Rows that repeat a doc_id are
    judged by their own text. Other columns are ignored. No rows: no rows.
    """
    found = repeated_passages(docs, width, gram, hot)
    whole = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("th", F.xxhash64("text"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, spans in zip(texts(batch.column("text")), batch.column("spans")):
                words = text.split()
                counts.append(len(words))
                gone = 0
                if spans.is_valid:
                    edge = np.zeros(len(words) + 1, np.int64)
                    start = spans.values.field("start").to_numpy()
                    n = spans.values.field("n").to_numpy()
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + n - 1 + width, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = int(len(words) - keep.sum())
                    words = [w for w, k in zip(words, keep.tolist()) if k]
                removed.append(gone)
                kept.append(b" ".join(words).decode())
            yield pa.record_batch(
                {
                    "doc_id": batch.column("doc_id"), "n_words": pa.array(counts, pa.int64()),
                    "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()),
                }
            )

    joined = whole.join(found, ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")

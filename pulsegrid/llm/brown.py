"""Scoring texts with Brown's class-based bigram model.

Exchange clustering gives every word a class; a text's probability is the product of class
transitions and word emissions, both smoothed. Words are told apart by a 64-bit hash.

Frequent words are exchanged one by one. Rarer words are exchanged in groups of equal ending, so the
class of any word, however rare, is known where it is read, while its count is looked up in the whole
vocabulary: in a bounded table for frequent words, by a join for all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import LOWER, cut, texts

#: Hash of the token that ends every text; no word's own hash is used for it.
END = 0
_CHUNK = 1 << 21


def tokens(text: bytes) -> list[bytes]:
    """Words of a text, A-Z in lower case; its end is not listed."""
    return text.translate(LOWER).split()


def hashes(words: list[bytes]) -> np.ndarray:
    """Signed 64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)


def ending(word: bytes, groups: int) -> int:
    """Group of a word by its last three bytes."""
    return xxhash.xxh32_intdigest(word[-3:]) % groups


def vocabulary(train: DataFrame, groups: int) -> DataFrame:
    """(h, g, n): every token of ``train`` (text), its ending group and its count. Counts are added
    up in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        ends = 0

        def flush() -> pa.RecordBatch:
            h, first, n = np.unique(hashes(held), return_index=True, return_counts=True)
            g = np.fromiter((ending(held[k], groups) for k in first.tolist()), np.int32, len(first))
            return pa.record_batch({"h": pa.array(h), "g": pa.array(g), "n": pa.array(n.astype(np.int64))})

        for batch in batches:
            for text in texts(batch.column("text")):
                held += tokens(text)
                ends += 1
                if len(held) >= _CHUNK:
                    yield flush()
                    held = []
        if held:
            yield flush()
        if ends:
            yield pa.record_batch(
                {"h": pa.array([END]), "g": pa.array([0], pa.int32()), "n": pa.array([ends])}
            )

    counted = train.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "h long, g int, n long")
    return counted.groupBy("h").agg(F.min("g").alias("g"), F.sum("n").alias("n"))


@dataclass
class Model:
    """What the executors need: frequent words (hash, count, unit), classes of the units, and the
    logarithms of transitions and of each class's emission denominator."""

    known: np.ndarray
    counts: np.ndarray
    words: int  # units below are words (the end first), the rest are ending groups
    groups: int
    classes: np.ndarray
    k: int  # number of classes
    total: int = 0
    types: int = 0
    transition: np.ndarray | None = None
    emission: np.ndarray | None = None


class Reader:
    """Turns texts into units, and tells which tokens are in the table of frequent words."""

    def __init__(self, model: Model):
        self.model = model
        self.place = {h: k for k, h in enumerate(model.known.tolist())}
        self.unit: dict[bytes, tuple[int, int]] = {}

    def _look(self, word: bytes) -> tuple[int, int]:
        m = self.model
        k = self.place.get(int(np.uint64(xxhash.xxh64_intdigest(word)).view(np.int64)), -1)
        unit = k if 0 <= k < m.words else m.words + ending(word, m.groups)
        if len(self.unit) >= 300_000:
            self.unit.clear()
        self.unit[word] = (k, unit)
        return k, unit

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each word its place among the frequent (or -1) and its unit."""
        get = self.unit.get
        pairs = [get(w) or self._look(w) for w in words]
        both = np.array(pairs, np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]


def _f(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def exchange(left: np.ndarray, right: np.ndarray, classes: np.ndarray, fixed: int = 1) -> np.ndarray:
    """One round of exchange: each unit in turn moves to the class where the class bigrams gain most
    likelihood. ``left``/``right`` count the class before and after each unit. The first ``fixed``
    units stay."""
    classes, k = classes.copy(), left.shape[1]
    pairs = np.zeros((k, k))
    np.add.at(pairs, classes, right)
    size = pairs.sum(axis=1)
    for u in np.argsort(-right.sum(axis=1), kind="stable").tolist():
        l, r, n = left[u], right[u], right[u].sum()
        if u < fixed or not n:
            continue
        own = classes[u]
        pairs[own] = np.maximum(pairs[own] - r, 0)
        pairs[:, own] = np.maximum(pairs[:, own] - l, 0)
        size[own] = max(0.0, size[own] - n)
        gain = (
            (_f(pairs + r) - _f(pairs)).sum(axis=1)
            + (_f(pairs + l[:, None]) - _f(pairs)).sum(axis=0)
            - 2 * (_f(size + n) - _f(size))
        )
        gain[classes[:fixed]] = -np.inf
        best = int(np.argmax(gain))
        classes[u] = best
        pairs[best] += r
        pairs[:, best] += l
        size[best] += n
    return classes


def _contexts(units: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Over all training texts, how often each unit follows and precedes each class. Counts are added
    up in each task, then by Spark; units times classes numbers reach the driver."""
    shared = units.sparkSession.sparkContext.broadcast(model.classes)
    n_units, k = len(model.classes), model.k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, n = shared.value, np.zeros(2 * n_units * k, np.int64)
        for batch in batches:
            for value in batch.column("units"):
                seq = np.frombuffer(value.as_py(), np.uint16).astype(np.int64)
                before, after = np.concatenate([[0], seq[:-1]]), seq
                np.add.at(n, after * k + classes[before], 1)
                np.add.at(n, n_units * k + before * k + classes[after], 1)
        some = np.flatnonzero(n)
        yield pa.record_batch({"cell": pa.array(some), "n": pa.array(n[some])})

    cells = units.mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(2 * n_units * k)
    n[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    return n[: n_units * k].reshape(n_units, k), n[n_units * k :].reshape(n_units, k)


def train(
    docs: DataFrame, classes: int = 32, rounds: int = 4, words: int = 4096, groups: int = 1024,
    table: int = 300_000,
) -> tuple[Model, DataFrame]:
    """Fit on all texts of ``docs``: the model, and the vocabulary (h, g, n).

    At most ``words`` words are exchanged one by one and at most ``table`` counts travel with the
    model: those above a count threshold read off a histogram of counts. All others have their
    count in the vocabulary and their class by their ending. The counts are those of every text.
    """
    vocab = cut(vocabulary(docs, groups), "vocabulary")
    scale = F.floor(F.log2("n") * 8).cast("int")
    histogram = {
        r["b"]: (r["types"], r["tokens"], r["least"])
        for r in vocab.groupBy(scale.alias("b"))
        .agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("tokens"), F.min("n").alias("least"))
        .collect()
    }

    def above(limit: int) -> int:
        """Smallest count that no more than ``limit`` types reach."""
        least, types = 1 << 62, 0
        for b in sorted(histogram, reverse=True):
            types += histogram[b][0]
            if types > limit:
                break
            least = histogram[b][2]
        return least

    total, types = sum(h[1] for h in histogram.values()), sum(h[0] for h in histogram.values())
    often = vocab.where((F.col("n") >= above(table)) & (F.col("h") != END)).toPandas()
    often = often.sort_values(["n", "h"], ascending=[False, True])
    ends = vocab.where(F.col("h") == END).first()
    known = np.concatenate([[END], often["h"].to_numpy(np.int64)])
    counts = np.concatenate([[ends["n"] if ends else 0], often["n"].to_numpy(np.int64)])
    n_words = 1 + int((often["n"].to_numpy() >= above(words)).sum())
    start = np.concatenate([[0], 1 + np.arange(n_words - 1 + groups) % (classes - 1)])
    model = Model(known, counts, n_words, groups, start, classes, int(total), int(types))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value)
        for batch in batches:
            yield pa.record_batch({"units": pa.array(
                [np.append(reader(tokens(t))[1], 0).astype(np.uint16).tobytes() for t in texts(batch.column("text"))],
                pa.binary(),
            )})

    text = docs.select(F.col("text").cast("string").alias("text"))
    units = cut(text.mapInArrow(encode, "units binary"), "units")
    for _ in range(rounds):
        model = replace(model, classes=exchange(*_contexts(units, model), model.classes))
    _, right = _contexts(units, model)
    pairs = np.zeros((classes, classes))
    np.add.at(pairs, model.classes, right)
    # a class has its frequent words and the rarer words of its ending groups
    rare = (
        vocab.where((F.col("n") < (counts[n_words - 1] if n_words > 1 else 1 << 62)) & (F.col("h") != END))
        .groupBy("g").agg(F.count(F.lit(1)).alias("types"), F.sum("n").alias("n")).toPandas()
    )
    kinds, mass = np.zeros(classes), np.zeros(classes)
    np.add.at(kinds, model.classes[:n_words], 1)
    np.add.at(mass, model.classes[:n_words], counts[:n_words])
    own = model.classes[n_words + rare["g"].to_numpy(np.int64)]
    np.add.at(kinds, own, rare["types"].to_numpy(float))
    np.add.at(mass, own, rare["n"].to_numpy(float))
    moves = (pairs + 0.5) / (pairs.sum(axis=1, keepdims=True) + 0.5 * classes)
    return replace(
        model, transition=np.log10(moves), emission=np.log10(mass + 0.5 * (kinds + 1))
    ), vocab


def score(docs: DataFrame, model: Model, vocab: DataFrame) -> DataFrame:
    """Score every row of ``docs`` (doc_id, text): rows (doc_id, n_tokens, n_known, train_tokens,
    base_score, score), in log10.

    ``base_score`` is the unigram estimate with half a count added, one type standing for unseen
    words; ``score`` is the class model's, smoothed alike within each class. Null and empty texts are
    an end only. Repeated rows are scored each, null ids are carried along, other columns ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        reader = Reader(model)
        seen = np.log10(model.counts + 0.5)
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("row", "n_tokens", "n_known", "seen", "score", "rare")}
            for text in texts(batch.column("text")):
                words = tokens(text)
                place, unit = reader(words)
                place, cls = np.append(place, 0), model.classes[np.append(unit, 0)]
                score = model.transition[np.append(0, cls[:-1]), cls].sum() - model.emission[cls].sum()
                found = place >= 0
                out["row"].append(row)
                out["n_tokens"].append(len(words) + 1)
                out["n_known"].append(int((model.counts[place[found]] > 0).sum()))
                out["seen"].append(float(seen[place[found]].sum()))
                out["score"].append(float(score))
                out["rare"].append(hashes([words[k] for k in np.flatnonzero(~found).tolist()]))
                row += 1
            yield pa.record_batch(
                {
                    "row": pa.array(out["row"], pa.int64()), "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array(out["n_tokens"], pa.int64()),
                    "n_known": pa.array(out["n_known"], pa.int64()),
                    "seen": pa.array(out["seen"], pa.float64()),
                    "score": pa.array(out["score"], pa.float64()),
                    "rare": pa.array(out["rare"], pa.list_(pa.int64())),
                }
            )

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    part = cut(
        picked.mapInArrow(
            run, "row long, doc_id long, n_tokens long, n_known long, seen double, score double, rare array<long>"
        ),
        "scores",
    )
    least = int(model.counts[1:].min()) if len(model.counts) > 1 else 1 << 62
    rest = vocab.where((F.col("n") < least) & (F.col("h") != END)).select("h", "n")
    looked = (
        part.select("row", F.explode("rare").alias("h")).join(rest, "h", "left")
        .groupBy("row")
        .agg(
            F.count("n").alias("more_known"),
            F.sum(F.log10(F.coalesce("n", F.lit(0)) + F.lit(0.5))).alias("more_seen"),
        )
    )
    seen = F.col("seen") + F.coalesce("more_seen", F.lit(0.0))
    return part.drop("rare").join(looked, "row", "left").select(
        "doc_id", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (seen - F.col("n_tokens") * F.log10(F.lit(model.total + 0.5 * (model.types + 1)))).alias("base_score"),
        (F.col("score") + seen).alias("score"),
    )

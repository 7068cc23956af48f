"""Isolation forest (Liu, Ting, Zhou 2008) fitted and applied as Spark jobs.

Each tree grows from a bounded sample (256 rows) drawn by row hash, so the same rows are drawn
whatever the partitioning. The fitted forest is a node table of at most ``trees * 511`` rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from pulsegrid.functions.quantiles import exact_quantiles
from pulsegrid.session import materialize

NODES = (
    "tree INT, node INT, feature INT, threshold DOUBLE, left INT, right INT, size INT, depth INT"
)
KEY = ("device_serial", "window_start")
_SPACE = 1 << 40


def mean_path(n) -> np.ndarray:
    """Average unsuccessful search length in a binary search tree of ``n`` keys."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3)
    long = 2 * (np.log(big - 1) + np.euler_gamma) - 2 * (big - 1) / big
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Nodes of one tree over the sampled rows: (node, feature, threshold, left, right, size, depth)."""
    nodes, todo = [], [(0, np.arange(len(x)), 0)]
    taken = 1
    while todo:
        node, rows, depth = todo.pop(0)
        part = x[rows]
        low, high = part.min(axis=0), part.max(axis=0)
        open_to_split = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or not len(open_to_split):
            nodes.append((node, -1, 0.0, -1, -1, len(rows), depth))
            continue
        f = int(rng.choice(open_to_split))
        cut = float(rng.uniform(low[f], high[f]))
        goes_left = part[:, f] < cut
        if not goes_left.any():
            cut = float(np.nextafter(low[f], high[f]))
            goes_left = part[:, f] < cut
        nodes.append((node, f, cut, taken, taken + 1, len(rows), depth))
        todo += [(taken, rows[goes_left], depth + 1), (taken + 1, rows[~goes_left], depth + 1)]
        taken += 2
    return nodes


def fit_nodes(vectors: DataFrame, trees: int, seed: int, sample: int, n: int) -> DataFrame:
    """Node table of a forest over ``vectors`` (key columns and ``x``)."""
    psi = min(sample, n)
    share = min(1.0, (psi + 6 * math.sqrt(psi) + 8) / n)
    draw = lambda t: F.pmod(F.xxhash64(*KEY, t, F.lit(seed + 1)), F.lit(_SPACE))
    offered = vectors.select(*KEY, "x", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    chosen = offered.withColumn("draw", draw(F.col("tree"))).where(F.col("draw") < int(_SPACE * share))
    limit = max(1, math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        rows = pdf.sort_values(["draw", *KEY]).head(psi)
        rng = np.random.default_rng([seed, tree])
        nodes = _grow(np.vstack(rows["x"].to_numpy()), rng, limit)
        names = ["node", "feature", "threshold", "left", "right", "size", "depth"]
        out = pd.DataFrame(nodes, columns=names)
        out.insert(0, "tree", tree)
        return out

    return chosen.groupBy("tree").applyInPandas(grow, NODES)


@dataclass
class FlatTree:
    """One tree as arrays indexed by node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # depth plus the expected rest of the path; meaningful at leaves
    depth: int

    @cached_property
    def column(self) -> np.ndarray:
        """Feature of each node, 0 at leaves."""
        return np.maximum(self.feature, 0).astype(np.intp)

    @cached_property
    def child(self) -> np.ndarray:
        """Left and right child of each node in turn; a leaf is its own."""
        own, leaf = np.arange(len(self.feature)), self.feature < 0
        both = [np.where(leaf, own, side) for side in (self.left, self.right)]
        return np.column_stack(both).ravel().astype(np.intp)


def flat_trees(nodes: pd.DataFrame) -> list[FlatTree]:
    out = []
    for _, t in nodes.sort_values(["tree", "node"]).groupby("tree"):
        out.append(
            FlatTree(
                t["feature"].to_numpy(),
                t["threshold"].to_numpy(),
                t["left"].to_numpy(),
                t["right"].to_numpy(),
                t["depth"].to_numpy() + mean_path(t["size"].to_numpy()),
                int(t["depth"].max()),
            )
        )
    return out


def path_lengths(trees: list[FlatTree], x: np.ndarray) -> np.ndarray:
    """Mean path length of each row over the forest."""
    total, flat = np.zeros(len(x)), np.ascontiguousarray(x, dtype=float).ravel()
    first = np.arange(len(x)) * x.shape[1]
    for t in trees:
        at = np.zeros(len(x), dtype=np.intp)
        for _ in range(t.depth):
            goes_left = flat.take(first + t.column.take(at)) < t.threshold.take(at)
            at = t.child.take(2 * at + ~goes_left)
        total += t.value.take(at)
    return total / max(len(trees), 1)


@dataclass
class IsolationForest:
    nodes: DataFrame
    sample: int
    offset: float

    @classmethod
    def fit(
        cls,
        vectors: DataFrame,
        trees: int = 200,
        contamination: float = 0.01,
        seed: int = 42,
        sample: int = 256,
    ) -> "IsolationForest":
        """Fit on a stored table of key columns and ``x``.

        The offset is the score that the ``contamination`` share of training rows exceeds."""
        n = vectors.count()
        if n == 0:
            raise ValueError("no training rows")
        nodes = materialize(fit_nodes(vectors, trees, seed, sample, n), "forest-nodes")
        model = cls(nodes, min(sample, n), 0.0)
        scored = materialize(model.score(vectors).select("anomaly_score"), "forest-train-scores")
        offset = exact_quantiles(scored, ["anomaly_score"], 1 - contamination)["anomaly_score"]
        return cls(nodes, min(sample, n), offset)

    def score(self, vectors: DataFrame) -> DataFrame:
        """Add ``anomaly_score``: positive for rows beyond the offset.

        The node table is bounded by its parameters, so it travels with the tasks."""
        spark = vectors.sparkSession
        trees = spark.sparkContext.broadcast(flat_trees(self.nodes.toPandas()))
        scale, offset = float(mean_path(self.sample)) or 1.0, self.offset

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if len(pdf):
                    mean = path_lengths(trees.value, np.vstack(pdf["x"].to_numpy()))
                    pdf = pdf.assign(anomaly_score=np.exp2(-mean / scale) - offset)
                else:
                    pdf = pdf.assign(anomaly_score=pd.Series(dtype=float))
                yield pdf.drop(columns="x")

        kept = [f for f in vectors.schema.fields if f.name != "x"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        return vectors.mapInPandas(run, f"{schema}, anomaly_score DOUBLE")

    def predict(self, vectors: DataFrame) -> DataFrame:
        """-1 for anomalies, 1 for normal rows."""
        label = F.when(F.col("anomaly_score") > 0, -1).otherwise(1)
        return self.score(vectors).withColumn("prediction", label)

"""Near-duplicate vectors by collision counting on sorted one-dimensional projections.

Every vector is projected on many random lines. On a line the vectors are sorted, and those within a
window around a query's value collide with it; close vectors collide on more lines than others.
Pairs that reach a count calibrated for recall are verified by their cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import erf, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.common import Forest, components, cut


def calibrate(threshold: float, lines: int, window: float, miss: float) -> int:
    """Largest collision count that two unit vectors of cosine ``threshold`` reach with a
    probability of at least 1 - ``miss``, their difference on a line being normal."""
    spread = sqrt(2 * (1 - threshold))
    p = erf(window / spread / sqrt(2)) if spread > 0 else 1.0
    below, term = 0.0, (1 - p) ** lines
    for count in range(lines + 1):
        if below + term > miss:
            return count
        below += term
        term *= (lines - count) / (count + 1) * p / (1 - p) if p < 1 else 0
    return lines


def block_links(
    a: np.ndarray, b: np.ndarray, directions: np.ndarray, window: float, least: int, threshold: float,
    same: bool,
) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of ``a`` with any, the rows of ``b`` whose cosine with it reaches ``threshold``
    among those that collide at least ``least`` times. Rows are unit vectors; with ``same``, b is a
    and a row is not compared with itself."""
    pa_, pb = a @ directions, b @ directions
    order = np.argsort(pb, axis=0, kind="stable")
    columns = [np.ascontiguousarray(order[:, k]) for k in range(order.shape[1])]
    ranges = []
    for k, col in enumerate(columns):
        values = pb[col, k]
        ranges.append(
            (np.searchsorted(values, pa_[:, k] - window, "left"), np.searchsorted(values, pa_[:, k] + window, "right"))
        )
    lo = np.stack([r[0] for r in ranges], axis=1).tolist()
    hi = np.stack([r[1] for r in ranges], axis=1).tolist()
    for i in range(len(a)):
        met = np.concatenate([c[x:y] for c, x, y in zip(columns, lo[i], hi[i])])
        near = np.flatnonzero(np.bincount(met, minlength=len(b)) >= least)
        near = near[b[near] @ a[i] >= threshold]
        if same:
            near = near[near != i]
        if len(near):
            yield i, near


def near_vectors(
    vectors: DataFrame, threshold: float = 0.93, lines: int = 24, window: float = 0.4,
    miss: float = 0.002, block: int = 2048, seed: int = 7,
) -> DataFrame:
    """Link rows of ``vectors`` (vec_id, embedding, label) of one label whose cosine, in double
    precision, reaches ``threshold``: rows (vec_id, n_links, component_id).

    ``n_links`` counts the other rows linked directly; ``component_id`` is the smallest vec_id
    reachable. A null label, and a vector that is null, zero or holds a null or a value that is not
    finite, links with nothing. Vectors of different lengths never link. Equal vectors are collapsed
    first and counted by their number. Repeated rows count as rows; null ids link and name a group
    only where nothing else does. Other columns are ignored. No rows: no rows.

    A first line routes the work: vectors are cut into cells as wide as nearly all close pairs are
    apart on it, a cell into blocks of about ``block`` vectors, and blocks of the same and of
    neighbouring cells are compared in tasks of their own. A task returns counts and a spanning
    forest of its links, never the links.
    """
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.col("embedding").cast("array<double>").alias("v"),
        F.col("label").cast("string").alias("label"),
    )
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    largest = F.aggregate("v", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x)))  # squares may underflow
    usable = (
        F.col("v").isNotNull() & F.col("label").isNotNull() & ~F.coalesce(bad, F.lit(True)) & (largest > 0)
    )
    keyed = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    good = (
        keyed.where("usable").groupBy("label", "v")
        .agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    )
    spread = sqrt(2 * (1 - threshold))
    width = 3.0 * spread  # of 370 pairs at the threshold one is further apart on the first line

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead = []
            for value in batch.column("v"):
                x = value.values.to_numpy(zero_copy_only=False)
                line = np.random.default_rng([seed, len(x)]).standard_normal(len(x))
                scale = np.abs(x).max()
                x = x / scale
                lead.append(int(np.floor(x @ line / np.linalg.norm(x) / width)))
            yield pa.record_batch(
                [*batch.columns, pa.array(lead, pa.int32())], names=[*batch.schema.names, "cell"]
            )

    placed = cut(
        good.mapInArrow(place, "label string, v array<double>, least long, copies long, cell int")
        .withColumns({"node": F.xxhash64("label", "v"), "dim": F.size("v")}),
        "vectors",
    )
    cells = placed.groupBy("label", "dim", "cell").agg(
        F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")
    )
    right = cells.select("label", "dim", (F.col("cell") - 1).alias("cell"), F.col("blocks").alias("after"))
    left = cells.select("label", "dim", (F.col("cell") + 1).alias("cell"), F.col("blocks").alias("before"))
    key = ["label", "dim", "cell"]
    sized = placed.join(
        cells.join(right, key, "left").join(left, key, "left"), key
    ).withColumn("sub", F.pmod("node", F.col("blocks")).cast("int"))
    # the tasks of a block: with itself and each other block of its cell, and with each block of the
    # next cell; named by the two blocks, the lower first
    pair = lambda c, s, d, t: F.struct(c.alias("ca"), s.alias("sa"), d.alias("cb"), t.alias("sb"))
    c, s = F.col("cell"), F.col("sub")
    upto = lambda n: F.when(F.coalesce(n, F.lit(0)) > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    within = F.transform(upto(F.col("blocks")), lambda t: pair(c, F.least(s, t), c, F.greatest(s, t)))
    onward = F.transform(upto(F.col("after")), lambda t: pair(c, s, c + 1, t))
    backward = F.transform(upto(F.col("before")), lambda t: pair(c - 1, t, c, s))
    dealt = sized.withColumn("task", F.explode(F.concat(within, onward, backward))).select(
        "node", "v", "copies", "label", "dim", "task.*",
        ((c == F.col("task.ca")) & (s == F.col("task.sa"))).alias("first"),
    )
    least = calibrate(threshold, lines, window, miss)

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        same = bool((group["ca"].iloc[0] == group["cb"].iloc[0]) and (group["sa"].iloc[0] == group["sb"].iloc[0]))
        group = group.sort_values("node")
        x = np.stack(group["v"].to_numpy())
        x = x / np.abs(x).max(axis=1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        node, copies = group["node"].to_numpy(), group["copies"].to_numpy()
        one = np.flatnonzero(group["first"].to_numpy())
        two = one if same else np.flatnonzero(~group["first"].to_numpy())
        directions = np.random.default_rng([seed, x.shape[1], 1]).standard_normal((x.shape[1], lines))
        n, forest, joined = np.zeros(len(node), np.int64), Forest(len(node)), []
        if len(one) and len(two):
            for i, near in block_links(x[one], x[two], directions, window, least, threshold, same):
                near = two[near]
                n[one[i]] += copies[near].sum()
                if not same:
                    n[near] += copies[one[i]]
                apart = near[forest.roots[near] != forest.roots[one[i]]]
                if len(apart):
                    joined += forest.join_all(np.full(len(apart), one[i]), apart)
        some = np.flatnonzero(n)
        a, b = (np.array(joined, np.int64).reshape(-1, 2)).T
        return pd.DataFrame(
            {
                "node": np.concatenate([node[some], node[a]]),
                "other": pd.array(np.concatenate([np.zeros(len(some), np.int64), node[b]]), "Int64"),
                "n": np.concatenate([n[some], np.zeros(len(a), np.int64)]),
            }
        )

    found = cut(
        dealt.groupBy("label", "dim", "ca", "sa", "cb", "sb").applyInPandas(compare, "node long, other long, n long"),
        "vector-links",
    )
    counts = found.where("n > 0").groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.where("n = 0").select(F.col("node").alias("a"), F.col("other").alias("b"))
    groups = components(edges, "vector-components")
    named = cut(
        placed.select("label", "v", "node", "least", "copies")
        .join(counts, "node", "left")
        .join(groups, "node", "left")
        .select(
            "label", "v", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("component", "node").alias("component"),
        ),
        "vector-groups",
    )
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = named.join(first, "component").select("label", "v", "n_links", "component_id")
    linked = keyed.where("usable").join(labels, ["label", "v"]).select("vec_id", "n_links", "component_id")
    alone = keyed.where(~F.col("usable")).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return linked.unionByName(alone)

"""Exact quantiles of many columns with bounded memory per task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SMALL = 20_000
BUCKETS = 1024
MOST = 8e307


def exact_quantiles(
    df: DataFrame, columns: list[str], q: float, small: int = SMALL
) -> dict[str, float | None]:
    """Linear-interpolated quantile of each column; nulls and NaN are ignored, infinities are the
    smallest and largest values.

    A column's value range is narrowed round by round: count rows per bucket of the current range
    (a bounded table per task, then an aggregate) and keep the bucket that holds the wanted rank, until
    at most ``small`` rows remain in it; those are sorted, one group per column. Columns that
    start small skip the rounds. Only per-column bounds reach the driver. ``df`` is scanned once
    per round (two or three rounds cover 10^11 rows), so it should be a stored table.
    """
    df = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    stats = _extent(df, columns)
    # (column, low, high) -> (rows in the range, {wanted rank: its position in the range})
    open_: dict[tuple, tuple[int, dict[int, int]]] = {}
    found: dict[tuple[str, int], float] = {}
    for i, c in enumerate(columns):
        n, lo, hi = stats.get(i, (0, None, None))
        if n:
            at = q * (n - 1)
            open_[(c, lo, hi)] = (n, {r: r for r in {math.floor(at), math.ceil(at)}})
    while any(n > small and lo < hi for (_, lo, hi), (n, _) in open_.items()):
        open_ = _narrow(df, open_, small)
    _pick(df, open_, found)

    out: dict[str, float | None] = {}
    for i, c in enumerate(columns):
        if i not in stats:
            out[c] = None
            continue
        at = q * (stats[i][0] - 1)
        low, high = found[(c, math.floor(at))], found[(c, math.ceil(at))]
        share = at - math.floor(at)
        out[c] = low + (high - low) * share if share and low != high else low
    return out


def literal(x: float) -> str:
    """A double as SQL text, infinite ones too."""
    return f"{x!r}D" if math.isfinite(x) else f"cast('{x}' as double)"


def _bucket(x: np.ndarray, lo: float, hi: float) -> np.ndarray:
    """Bucket of each value; infinite bounds stand beyond half the largest number."""
    low, high = max(lo, -MOST), min(hi, MOST)
    width = high / BUCKETS - low / BUCKETS
    if width <= 0:
        return np.where(x > lo, BUCKETS - 1, 0)
    return np.minimum((np.clip(x, low, high) - low) / width, BUCKETS - 1).astype(np.int64)


def _known(batch: pa.RecordBatch, column: str) -> np.ndarray:
    """Values of a column that are neither null nor NaN."""
    x = batch.column(column).to_numpy(zero_copy_only=False)
    return x[~np.isnan(x)]


def _extent(df: DataFrame, columns: list[str]) -> dict[int, tuple[int, float, float]]:
    """Number of values, smallest and largest of each column that has any, by position. Dozens of
    columns are counted batch by batch in the tasks, a row per column and task is left to Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, lo, hi = np.zeros(len(columns), np.int64), np.full(len(columns), np.inf), np.full(len(columns), -np.inf)
        for batch in batches:
            for i, c in enumerate(columns):
                if len(x := _known(batch, c)):
                    n[i], lo[i], hi[i] = n[i] + len(x), min(lo[i], x.min()), max(hi[i], x.max())
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array(v) for v in (at, n[at], lo[at], hi[at])], names=["j", "n", "lo", "hi"])

    parts = df.mapInArrow(run, "j long, n long, lo double, hi double")
    rows = parts.groupBy("j").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return {r["j"]: (r["n"], r["lo"], r["hi"]) for r in rows.collect()}


def _values(df: DataFrame, keys: list[tuple]) -> DataFrame:
    """Long ``(j, x)`` table of the values inside each key's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for j, (c, lo, hi) in enumerate(keys):
                x = _known(batch, c)
                x = x[(lo <= x) & (x <= hi)]
                if len(x):
                    yield pa.record_batch([pa.array(np.full(len(x), j)), pa.array(x)], names=["j", "x"])

    return df.select(*{c for c, _, _ in keys}).mapInArrow(run, "j long, x double")


def _cells(df: DataFrame, keys: list[tuple]) -> DataFrame:
    """``(j, b, n, lo, hi)``: values inside each key's range, counted by bucket, a row per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = (len(keys), BUCKETS)
        n, low, high = np.zeros(shape, np.int64), np.full(shape, np.inf), np.full(shape, -np.inf)
        for batch in batches:
            for j, (c, lo, hi) in enumerate(keys):
                x = _known(batch, c)
                x = x[(lo <= x) & (x <= hi)]
                b = _bucket(x, lo, hi)
                n[j] += np.bincount(b, minlength=BUCKETS)
                np.minimum.at(low[j], b, x)
                np.maximum.at(high[j], b, x)
        j, b = np.nonzero(n)
        columns = [j, b, n[j, b], low[j, b], high[j, b]]
        yield pa.record_batch([pa.array(v) for v in columns], names=["j", "b", "n", "lo", "hi"])

    return df.select(*{c for c, _, _ in keys}).mapInArrow(run, "j long, b long, n long, lo double, hi double")


def _narrow(df: DataFrame, open_: dict, small: int) -> dict:
    """One round over the ranges that still hold many rows."""
    todo = [k for k, (n, _) in open_.items() if n > small and k[1] < k[2]]
    left = {k: v for k, v in open_.items() if k not in todo}
    cells = (
        _cells(df, todo)
        .groupBy("j", "b")
        .agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        .orderBy("j", "b")
        .collect()
    )
    for j, key in enumerate(todo):
        before = 0
        for cell in (c for c in cells if c["j"] == j):
            held = {
                rank: at - before
                for rank, at in open_[key][1].items()
                if before <= at < before + cell["n"]
            }
            if held:
                left[(key[0], cell["lo"], cell["hi"])] = (cell["n"], held)
            before += cell["n"]
    return left


def _pick(df: DataFrame, open_: dict, found: dict) -> None:
    """Values at the wanted positions of ranges that are small or hold one value only."""
    many = []
    for (c, lo, hi), (_, ranks) in open_.items():
        if lo == hi:
            found.update({(c, r): lo for r in ranks})
        else:
            many.append((c, lo, hi))
    if not many:
        return
    arms = lambda k: " ".join(
        f"when {j} then {sorted(open_[key][1].values())[k]}" for j, key in enumerate(many)
    )
    sorted_ = _values(df, many).groupBy("j").agg(F.sort_array(F.collect_list("x")).alias("v"))
    picked = sorted_.selectExpr("j", f"v[case j {arms(0)} end] as a", f"v[case j {arms(-1)} end] as b")
    for row in picked.collect():
        key = many[row["j"]]
        ranks = sorted(open_[key][1])
        found[(key[0], ranks[0])] = row["a"]
        found[(key[0], ranks[-1])] = row["b"]

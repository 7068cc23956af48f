"""Sliding windows over row positions, their metadata, tensors and summaries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pulsegrid.fixed import STATISTICS
from pulsegrid.functions.grid import seconds
from pulsegrid.operators.ordered import add_ordinals, time_slice

SLICE = "1d"
BLOCK_WINDOWS = 512


def cadence(wide: DataFrame, slice: str = SLICE) -> DataFrame:
    """Median of successive time differences per device, in seconds.

    Differences are counted per distinct length before the exact median, so the aggregate state
    is the number of distinct lengths, not the number of rows."""
    rows = wide.where("device_serial is not null").select(
        "device_serial",
        F.unix_micros("timestamp").alias("t"),
        time_slice(F.col("timestamp"), seconds(slice)).alias("s"),
    )
    edges = rows.groupBy("device_serial", "s").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    by_slice = W.partitionBy("device_serial").orderBy("s")
    across = edges.select("device_serial", (F.col("lo") - F.lag("hi").over(by_slice)).alias("gap"))
    inside = W.partitionBy("device_serial", "s").orderBy("t")
    within = rows.select("device_serial", (F.col("t") - F.lag("t").over(inside)).alias("gap"))
    counted = (
        within.unionByName(across)
        .where("gap is not null")
        .groupBy("device_serial", "gap")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    return counted.groupBy("device_serial").agg(
        (F.percentile("gap", F.lit(0.5), F.col("times")) / 1e6).alias("cadence_s")
    )


def window_sizes(cadence_s: Column, window: str, step: str, sizing: str) -> tuple[Column, Column]:
    """Rows per window and rows per step. ``by_step`` sizing takes the step as the sampling
    interval whenever the data is at least that dense; ``duration`` uses the true interval."""
    if sizing not in ("by_step", "duration"):
        raise ValueError(f"unknown sizing: {sizing!r}")
    base = cadence_s
    if sizing == "by_step":
        base = F.greatest(cadence_s, F.lit(float(seconds(step))))
    rows = lambda span: F.greatest(F.lit(1), F.bround(F.lit(float(seconds(span))) / base, 0)).cast("bigint")
    return rows(window), rows(step)


def place_rows(
    wide: DataFrame,
    features: list[str],
    window: str = "30min",
    step: str = "5min",
    sizing: str = "by_step",
    slice: str = SLICE,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """Rows beside the rows they share windows with: ``device_serial, block, rn, lo, hi, win, stride``.

    Rows are numbered per device by time slices, then placed into blocks of ``block_windows``
    window starts together with the few following rows those windows need. Both shuffles move
    each row about once, no device is confined to one task, and what follows per
    ``(device_serial, block)`` needs no further shuffle. ``lo`` and ``hi`` are the first and last
    window of the block that contain the row.
    """
    rows = wide.where("device_serial is not null").select("device_serial", "timestamp", *features)
    sized = cadence(wide, slice).select(
        "device_serial",
        *[
            c.alias(n)
            for n, c in zip(("win", "stride"), window_sizes(F.col("cadence_s"), window, step, sizing))
        ],
    )
    rows = rows.withColumn("_slice", time_slice(F.col("timestamp"), seconds(slice)))
    numbered = add_ordinals(rows, ["device_serial"], ["timestamp"], "_slice", per_key=sized)
    keep = ["device_serial", "timestamp", "rn", "win", "stride", *features]
    placed = numbered.where("win >= 2 and n >= win").selectExpr(
        *keep,
        "cast(greatest(0, ceil((rn - win + 1) / stride)) as bigint) as first_k",
        "cast(least(floor(rn / stride), floor((n - win) / stride)) as bigint) as last_k",
    )
    b = block_windows
    return (
        placed.where("first_k <= last_k")
        .selectExpr(*keep, "first_k", "last_k",
                    f"explode(sequence(first_k div {b}, last_k div {b})) as block")
        .repartition("device_serial", "block")
        .selectExpr(*keep, "block", f"greatest(first_k, block * {b}) as lo",
                    f"least(last_k, (block + 1) * {b} - 1) as hi")
    )


def sliding_windows(
    wide: DataFrame,
    features: list[str],
    window: str = "30min",
    step: str = "5min",
    sizing: str = "by_step",
    slice: str = SLICE,
    block_windows: int = BLOCK_WINDOWS,
    max_span: str | None = None,
) -> DataFrame:
    """One row per (window, member row): ``device_serial, block, window_idx, pos, win, timestamp``
    and the features. ``max_span`` drops windows that bridge a longer gap."""
    placed = place_rows(wide, features, window, step, sizing, slice, block_windows)
    out = placed.selectExpr("*", "explode(sequence(lo, hi)) as window_idx").selectExpr(
        "device_serial", "block", "window_idx", "rn - window_idx * stride as pos", "win",
        "timestamp", *features,
    )
    if max_span is None:
        return out
    span = F.max("timestamp").over(_window_key()).cast("double") - F.min("timestamp").over(
        _window_key()
    ).cast("double")
    return out.withColumn("_span", span).where(F.col("_span") <= seconds(max_span)).drop("_span")


def _window_key():
    return W.partitionBy("device_serial", "block", "window_idx")


def _meta() -> list[Column]:
    return [
        F.min("timestamp").alias("window_start"),
        F.max("timestamp").alias("window_end"),
        F.count(F.lit(1)).cast("int").alias("n_samples"),
    ]


def window_metadata(members: DataFrame) -> DataFrame:
    return (
        members.groupBy("device_serial", "block", "window_idx").agg(*_meta()).drop("block")
    )


def window_tensor(
    members: DataFrame, features: list[str], length: int | str | None = None
) -> DataFrame:
    """Rows of each window in order as ``array<array<double>>``; a window holds ``win`` rows.

    ``length`` pads shorter windows with null rows at the end, "longest" to the longest window of the
    table; ``n_samples`` tells how many rows of a window are its own."""
    if length == "longest":
        length = members.agg(F.max("win")).first()[0] or 0
    row = F.struct("pos", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    out = (
        members.groupBy("device_serial", "block", "window_idx")
        .agg(*_meta(), F.array_sort(F.collect_list(row)).alias("_rows"))
        .withColumn("tensor", F.transform("_rows", lambda r: r["x"]))
        .drop("_rows", "block")
    )
    if length is None:
        return out
    empty = F.array(*[F.lit(None).cast("double") for _ in features])
    short = F.greatest(F.lit(0), F.lit(length) - F.size("tensor"))
    return out.withColumn("tensor", F.concat("tensor", F.array_repeat(empty, short)))


def summary_columns(features: list[str]) -> list[str]:
    """Names of the summary vector in model order: statistic by statistic."""
    return [f"{f}__{s}" for s in STATISTICS for f in features]


def window_stats(members: DataFrame, features: list[str]) -> DataFrame:
    """Mean, population deviation, minimum, maximum and last-minus-first of each feature.

    Plain aggregates over the rows of :func:`sliding_windows`; fit for a handful of features.
    Wide vectors go through :func:`window_summaries`."""
    aggs = []
    for f in features:
        aggs += [
            f"avg({f}) as {f}__mean",
            f"stddev_pop({f}) as {f}__std",
            f"cast(min({f}) as double) as {f}__min",
            f"cast(max({f}) as double) as {f}__max",
            f"cast(coalesce(max(case when pos = win - 1 then {f} end) - max(case when pos = 0 then {f} end), 0)"
            f" as double) as {f}__delta",
        ]
    out = members.groupBy("device_serial", "block", "window_idx").agg(
        *_meta(), *[F.expr(a) for a in aggs]
    )
    return out.select(
        "device_serial", "window_idx", "window_start", "window_end", "n_samples",
        *summary_columns(features),
    )


def window_summaries(
    wide: DataFrame,
    features: list[str],
    window: str = "30min",
    step: str = "5min",
    sizing: str = "by_step",
    slice: str = SLICE,
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """The table of :func:`window_stats` for many features.

    Five aggregates over each of dozens of features exceed what one generated aggregate handles
    well, and every row would be copied into each of its windows first. Here Spark places and
    sorts the rows, and each task turns its stream of Arrow batches into window vectors; only
    one batch and the few rows of an unfinished window are held at a time."""
    placed = place_rows(wide, features, window, step, sizing, slice, block_windows)
    ready = placed.sortWithinPartitions("device_serial", "block", "rn")
    names = summary_columns(features)
    schema = (
        "device_serial string, window_idx bigint, window_start timestamp, window_end timestamp, "
        "n_samples int, " + ", ".join(f"{c} double" for c in names)
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            if rows.num_rows:
                longest = pc.max(rows["win"]).as_py()
                done = max(0, rows.num_rows - longest + 1)
                yield _summaries(rows, done, features, names)
                rest = rows.slice(done)
        if rest is not None and rest.num_rows:
            yield _summaries(rest, rest.num_rows, features, names)

    return ready.mapInArrow(run, schema)


def _summaries(rows: pa.Table, until: int, features: list[str], names: list[str]) -> pa.RecordBatch:
    """Vectors of the windows that start in the first ``until`` of the sorted rows."""
    col = lambda c: rows[c].to_numpy()
    rn, stride, win, block = col("rn"), col("stride"), col("win"), col("block")
    k = rn // stride
    at = np.arange(len(rn))
    opens = (rn % stride == 0) & (col("lo") <= k) & (k <= col("hi")) & (at < until)
    opens &= at + win <= len(rn)
    values = np.column_stack([col(f).astype(float) for f in features])
    chosen, stats = [], []
    for size in np.unique(win[opens]):
        start = np.flatnonzero(opens & (win == size))
        x = np.lib.stride_tricks.sliding_window_view(values, size, axis=0)[start]
        chosen.append(start)
        stats.append(_statistics(x))
    if not chosen:
        chosen, stats = [at[:0]], [np.empty((0, len(names)))]
    start, table = np.concatenate(chosen), np.vstack(stats)
    pick = lambda c, i: rows[c].combine_chunks().take(pa.array(i))
    arrays = [
        pick("device_serial", start),
        pa.array(k[start]),
        pick("timestamp", start),
        pick("timestamp", start + win[start] - 1),
        pa.array(win[start].astype("int32")),
        *[pa.array(table[:, j], from_pandas=True) for j in range(len(names))],
    ]
    head = ["device_serial", "window_idx", "window_start", "window_end", "n_samples"]
    return pa.RecordBatch.from_arrays(arrays, names=head + names)


def _statistics(x: np.ndarray) -> np.ndarray:
    """Mean, deviation, minimum, maximum and delta of ``(window, feature, row)``; NaN is absent."""
    known = ~np.isnan(x)
    count = known.sum(axis=2).astype(float)
    count[count == 0] = np.nan
    mean = np.where(known, x, 0.0).sum(axis=2) / count
    off = np.where(known, x - mean[:, :, None], 0.0)
    low = np.where(known, x, np.inf).min(axis=2)
    high = np.where(known, x, -np.inf).max(axis=2)
    return np.hstack(
        [
            mean,
            np.sqrt((off**2).sum(axis=2) / count),
            np.where(np.isinf(low), np.nan, low),
            np.where(np.isinf(high), np.nan, high),
            np.nan_to_num(x[:, :, -1] - x[:, :, 0]),
        ]
    )

"""Fleet percentile and threshold runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from pulsegrid.functions.grid import seconds
from pulsegrid.operators.ordered import add_ordinals, time_slice, value_slice

SLICE = "1d"


def fleet_percentile(
    scores: DataFrame, score: str = "anomaly_score", min_fleet: int | None = None
) -> DataFrame:
    """Share of the fleet at the same timestamp that scores at or below each row.

    Ties share their average rank; a null or NaN score has no percentile and does not count. Equal
    scores first collapse into one counted row (map-side combined), those are ranked inside
    ``(timestamp, score bucket)`` and shifted by the rows in lower buckets, so neither a crowded
    timestamp nor a much-repeated score sits in one task. ``min_fleet`` blanks timestamps with
    fewer rows.
    """
    counted = (
        scores.where(F.col(score).isNotNull() & ~F.isnan(score))
        .groupBy("timestamp", score)
        .agg(F.count(F.lit(1)).alias("_ties"))
        .withColumn("_bucket", value_slice(F.col(score)))
    )
    lower = W.partitionBy("timestamp").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        counted.groupBy("timestamp", "_bucket")
        .agg(F.sum("_ties").alias("_rows"))
        .select(
            "timestamp",
            "_bucket",
            F.coalesce(F.sum("_rows").over(lower), F.lit(0)).alias("_below"),
            F.sum("_rows").over(W.partitionBy("timestamp")).alias("_fleet"),
        )
    )
    inside = W.partitionBy("timestamp", "_bucket").orderBy(score).rowsBetween(W.unboundedPreceding, 0)
    rank = F.col("_below") + F.sum("_ties").over(inside) - (F.col("_ties") - 1) / 2
    pct = rank / F.col("_fleet")
    if min_fleet is not None:
        pct = F.when(F.col("_fleet") >= min_fleet, pct)
    ranked = counted.join(offsets, ["timestamp", "_bucket"]).select(
        "timestamp", score, pct.alias("fleet_percentile")
    )
    kept = [c for c in scores.columns if c != "fleet_percentile"]
    return (
        scores.select(*kept).join(ranked, ["timestamp", score], "left").select(*kept, "fleet_percentile")
    )


def threshold_runs(
    scores: DataFrame,
    threshold: float = 0.95,
    keys: tuple[str, ...] = ("device_serial",),
    order: tuple[str, ...] = ("window_end",),
    slice: str = SLICE,
) -> DataFrame:
    """Label each row with the run of consecutive rows at or above the threshold it belongs to.

    Above-threshold rows of one run share ``row position - number of above rows so far``; rows
    below the threshold get a null ``run_id``. Runs are then plain groups, so they aggregate with
    map-side combining instead of a second ordered pass."""
    above = F.coalesce(F.col("fleet_percentile") >= threshold, F.lit(False))
    sliced = scores.withColumns(
        {"_above": above, "_slice": time_slice(F.col(order[0]), seconds(slice))}
    )
    numbered = add_ordinals(
        sliced, list(keys), list(order), "_slice", marks={"_hits": F.col("_above")}
    )
    run = F.when(F.col("_above"), F.col("rn") - F.col("_hits"))
    return numbered.withColumn("run_id", run).drop("_above", "_hits", "_slice", "n")


def run_table(runs: DataFrame, keys: tuple[str, ...] = ("device_serial",)) -> DataFrame:
    """One row per run: start, end, length and maxima."""
    return (
        runs.where("run_id is not null")
        .groupBy(*keys, "run_id")
        .agg(
            F.min("window_start").alias("run_start"),
            F.max("window_end").alias("run_end"),
            F.count(F.lit(1)).alias("n_windows"),
            F.max("anomaly_score").alias("max_score"),
            F.max("fleet_percentile").alias("max_percentile"),
        )
    )

"""Evaluation against known events: windows around events, lead time, service control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.grid import at_midnight, days_between
from pulsegrid.operators.rank import run_table, threshold_runs


def event_days(events: DataFrame, first: int, last: int) -> DataFrame:
    """One row per event and calendar day from ``date+first`` to ``date+last``.

    Expanding the (small) event side by days turns an interval join into an equality join on
    ``(device_serial, day)``: a device with a long history is spread over its days, and only rows
    that can match meet."""
    day = F.col("event_date")
    return events.withColumn(
        "day", F.explode(F.sequence(F.date_add(day, first), F.date_add(day, last)))
    )


def event_windows(
    scores: DataFrame, events: DataFrame, pre_days: int = 14, post_days: int = 2
) -> DataFrame:
    """Scores of each event's device from ``date-pre`` to ``date+post``, both ends included."""
    at = at_midnight(F.col("event_date"))
    return (
        scores.withColumn("day", F.to_date("timestamp"))
        .join(event_days(events, -pre_days, post_days), ["device_serial", "day"])
        .where(F.col("timestamp") <= at_midnight(F.date_add("event_date", post_days)))
        .withColumn("days_to_event", days_between(F.col("timestamp"), at))
        .drop("day")
    )


def lead_time(
    event_scores: DataFrame, threshold: float = 0.95, sustained: int = 3
) -> DataFrame:
    """Days between the first sustained exceedance before each event and the event.

    Events without one are absent."""
    at = at_midnight(F.col("event_date"))
    before = event_scores.where(F.col("timestamp") < at).withColumns(
        {"window_start": F.col("timestamp"), "window_end": F.col("timestamp")}
    )
    keys = ("event_id", "event_date")
    runs = run_table(threshold_runs(before, threshold, keys=keys, order=("timestamp",)), keys)
    return (
        runs.where(F.col("n_windows") >= sustained)
        .groupBy(*keys)
        .agg(F.min("run_start").alias("first_detection"))
        .select("event_id", days_between(at, F.col("first_detection")).alias("lead_time_days"))
    )


def evaluate_model(
    ranked: DataFrame,
    events: DataFrame,
    model_name: str,
    threshold: float = 0.95,
    sustained: int = 3,
    pre_days: int = 14,
    post_days: int = 2,
) -> DataFrame:
    """One row per event: detected, lead time, highest percentile before it, rows seen.

    ``ranked`` already carries ``fleet_percentile`` over the whole fleet."""
    near = event_windows(ranked, events, pre_days, post_days)
    at = at_midnight(F.col("event_date"))
    seen = near.groupBy("event_id").agg(
        F.max(F.when(F.col("timestamp") < at, F.col("fleet_percentile"))).alias("max_percentile_pre"),
        F.count(F.lit(1)).alias("n_score_points"),
    )
    return (
        events.join(seen, "event_id", "left")
        .join(lead_time(near, threshold, sustained), "event_id", "left")
        .select(
            F.lit(model_name).alias("model"),
            "event_id",
            "cmms_reg",
            "event_date",
            "description",
            F.col("lead_time_days").isNotNull().alias("detected"),
            "lead_time_days",
            "max_percentile_pre",
            F.coalesce("n_score_points", F.lit(0)).alias("n_score_points"),
        )
    )


def model_comparison(results: list[DataFrame]) -> DataFrame:
    """Detections out of all events and mean lead time, per model."""
    every = results[0]
    for more in results[1:]:
        every = every.unionByName(more)
    return every.groupBy("model").agg(
        F.concat_ws(
            "/", F.count_if("detected").cast("string"), F.count(F.lit(1)).cast("string")
        ).alias("events_detected"),
        F.avg("lead_time_days").alias("mean_lead_time"),
    )


def detection_summary(result: DataFrame) -> DataFrame:
    return result.groupBy("model").agg(
        F.count_if("detected").alias("n_detected"),
        F.count(F.lit(1)).alias("n_events"),
        F.coalesce(F.avg("lead_time_days"), F.lit(0.0)).alias("mean_lead_time"),
    )


def service_control(
    scores: DataFrame, services: DataFrame, pre_days: int = 7, score: str = "anomaly_score"
) -> DataFrame:
    """Mean score in the days before each scheduled service against the fleet baseline.

    The interval is whole days, so scores shrink to one row per (device, day) before they meet
    the expanded events. Events without scores stay with nulls."""
    daily = scores.groupBy("device_serial", F.to_date("timestamp").alias("day")).agg(
        F.sum(score).alias("_sum"), F.count(score).alias("_n"), F.count(F.lit(1)).alias("_rows")
    )
    pre = (
        event_days(services, -pre_days, -1)
        .join(daily, ["device_serial", "day"])
        .groupBy("event_id")
        .agg(
            (F.sum("_sum") / F.nullif(F.sum("_n"), F.lit(0))).alias("mean_score_pre"),
            F.sum("_rows").alias("n_points"),
        )
    )
    base: dict[str, Column] = {
        name: scores.select(agg.alias(name)).scalar()
        for name, agg in (("mean", F.avg(score)), ("std", F.stddev_samp(score)))
    }
    z = F.when(base["std"] > 0, (F.col("mean_score_pre") - base["mean"]) / base["std"]).otherwise(0.0)
    zscore = F.when(F.col("n_points").isNotNull(), z)
    return services.join(pre, "event_id", "left").select(
        "event_id",
        "cmms_reg",
        F.col("event_date").alias("pv_date"),
        "mean_score_pre",
        zscore.alias("zscore_vs_fleet"),
        (zscore > 2.0).alias("elevated"),
        F.coalesce("n_points", F.lit(0)).alias("n_points"),
    )

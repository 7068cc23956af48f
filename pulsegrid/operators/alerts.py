"""Sustained alerts, run summaries, cooldown and digest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pulsegrid import fixed
from pulsegrid.functions.text import top_features_text
from pulsegrid.operators.rank import SLICE, threshold_runs


def advice(level: Column) -> Column:
    text = F.when(level == "critical", fixed.ADVICE["critical"])
    text = text.when(level == "warning", fixed.ADVICE["warning"])
    return text.otherwise(fixed.ADVICE["normal"])


def sustained_alerts(
    scores: DataFrame,
    registry: DataFrame,
    threshold: float = 0.95,
    sustained: int = 3,
    critical: float = 0.99,
    features: list[str] | None = None,
    slice: str = SLICE,
) -> DataFrame:
    """One row per run of at least ``sustained`` windows; one "normal" row per other device.

    One pass: rows fall into runs, short runs and quiet rows of a device collapse into one rest
    row, and a device's rest row survives only if it has no qualifying run."""
    runs = threshold_runs(scores, threshold, slice=slice)
    by_run = runs.groupBy("device_serial", "run_id").agg(
        F.max("anomaly_score").alias("score"),
        F.max("fleet_percentile").alias("pct"),
        F.min("window_start").alias("alert_start"),
        F.max("window_end").alias("alert_end"),
        F.count(F.lit(1)).alias("n"),
    )
    kept = F.when(F.col("n") >= sustained, F.col("run_id"))
    folded = (
        by_run.withColumn("run_id", kept)
        .groupBy("device_serial", "run_id")
        .agg(
            F.max("score").alias("score"),
            F.max("pct").alias("pct"),
            F.min("alert_start").alias("alert_start"),
            F.max("alert_end").alias("alert_end"),
            F.sum("n").alias("n"),
        )
    )
    is_run = F.col("run_id").isNotNull()
    alarmed = F.max(is_run).over(W.partitionBy("device_serial"))
    level = (
        F.when(is_run & (F.col("pct") >= critical), "critical")
        .when(is_run, "warning")
        .otherwise("normal")
    )
    rows = (
        folded.withColumn("_alarmed", alarmed)
        .where(is_run | ~F.col("_alarmed"))
        .withColumn("alert_level", level)
    )
    reg = registry.select("device_serial", "cmms_reg")
    top = top_features_text(features or fixed.MODEL_FEATURES)
    return rows.join(reg, "device_serial", "left").select(
        "device_serial",
        "cmms_reg",
        "alert_level",
        F.round("score", 4).alias("anomaly_score"),
        F.round("pct", 4).alias("fleet_percentile"),
        F.when(is_run, F.lit(top)).otherwise("").alias("top_contributing_features"),
        advice(F.col("alert_level")).alias("recommended_action"),
        F.when(is_run, F.col("alert_start")).alias("alert_start"),
        F.when(is_run, F.col("alert_end")).alias("alert_end"),
        F.when(is_run, F.col("n")).otherwise(0).cast("int").alias("n_anomalous_windows"),
    )


def level_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("alert_level").agg(F.count(F.lit(1)).alias("n_alerts"))


def run_summary(scores: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row per scored device: highest score and percentile, level of its first alert."""
    peaks = scores.groupBy("device_serial").agg(
        F.max("anomaly_score").alias("anomaly_score"),
        F.max("fleet_percentile").alias("fleet_percentile"),
    )
    first = alerts.groupBy("device_serial").agg(
        F.min_by("alert_level", F.coalesce("alert_start", F.lit(0).cast("timestamp"))).alias("level")
    )
    return peaks.join(first, "device_serial", "left").select(
        "device_serial",
        F.coalesce("level", F.lit("normal")).alias("alert_level"),
        "anomaly_score",
        "fleet_percentile",
    )


def cooldown(
    alerts: DataFrame, history: DataFrame, now: dt.datetime | Column, hours: float = 24
) -> DataFrame:
    """Actionable alerts of devices whose newest notified alert is not too recent.

    The newest notified warning-or-worse row per device is an aggregate; devices still inside
    the cooldown are removed with an anti join."""
    now = now if isinstance(now, Column) else F.lit(now)
    actionable = alerts.where(F.col("alert_level").isin("warning", "critical"))
    newest = (
        history.where(F.col("notified") & F.col("alert_level").isin("warning", "critical"))
        .groupBy("device_serial")
        .agg(F.max_by("notified_at", F.struct("timestamp", "id")).alias("notified_at"))
    )
    quiet = newest.where(
        F.unix_micros("notified_at") > F.unix_micros(now) - F.lit(int(hours * 3_600_000_000))
    )
    return actionable.join(quiet.select("device_serial"), "device_serial", "left_anti")


def digest(alerts: DataFrame, base_url: str = "http://localhost:8000") -> DataFrame:
    """Notification text: one block per alert, and the subject for all of them.

    The body is the blocks in ``(device_serial, timestamp)`` order. It stays a distributed table,
    so a large fleet's digest never gathers in one row."""
    n = alerts.select(F.count(F.lit(1)).alias("n")).scalar()
    word = F.when(n == 1, "device").otherwise("devices")
    reg = F.coalesce(F.col("cmms_reg").cast("string"), F.lit("?"))
    drivers = F.when(
        F.col("top_contributing_features") != "",
        F.concat(F.lit("  Top drivers: "), F.col("top_contributing_features")),
    )
    since = F.date_format("alert_start", "yyyy-MM-dd HH:mm:ss")
    share = F.format_string("%.0f%%", F.bround(F.coalesce("fleet_percentile", F.lit(0.0)) * 100, 0))
    return alerts.select(
        "device_serial",
        F.col("alert_start").alias("timestamp"),
        F.concat(F.lit("PdM Alert — "), n.cast("string"), F.lit(" "), word,
                 F.lit(" requires attention")).alias("subject"),
        F.concat_ws(
            "\n",
            F.concat(F.lit("Device "), reg, F.lit(" — "), F.upper("alert_level"),
                     F.lit(" (fleet percentile: "), share, F.lit(")")),
            F.concat(F.lit("  Since: "), since),
            drivers,
            F.concat(F.lit(f"  Details: {base_url}/device/"), F.col("device_serial")),
            F.lit(""),
        ).alias("block"),
    )


def error_notice(health: DataFrame) -> DataFrame:
    """Notification text for failed jobs."""
    failed = health.where("status = 'failure'")
    at = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")
    return failed.select(
        "job_name",
        "timestamp",
        F.concat(F.lit("PdM Service Error — "), F.col("job_name")).alias("subject"),
        F.concat(
            F.lit("Job: "), F.col("job_name"), F.lit("\nTime: "), at,
            F.lit("\nError: "), F.coalesce("error_message", F.lit("")), F.lit("\n"),
        ).alias("body"),
    )


def fleet_status(latest: DataFrame) -> DataFrame:
    """Status band of each device from its percentile (a fraction)."""
    pct = F.col("fleet_percentile") * 100
    return latest.select(
        "device_serial",
        "fleet_percentile",
        F.when(pct >= 99, "critical").when(pct >= 95, "warning").otherwise("normal").alias("band"),
    )

"""Queries over, and updates of, the state tables (alerts, health, orders, labels, models, cache).

Updates return the new table content or the rows to append; :mod:`pulsegrid.sources.tables`
writes them. Row ids are hashes of the natural key, so appends need no global counter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid import fixed


def newest_first(df: DataFrame, by: str, limit: int | None = None) -> DataFrame:
    """Order by a time column, newest first, id as tie-break; ``limit`` becomes a top-k."""
    out = df.orderBy(F.desc(by), F.desc("id")) if "id" in df.columns else df.orderBy(F.desc(by))
    return out if limit is None else out.limit(limit)


def at_least(level: str) -> Column:
    """Alert level at or above ``level``."""
    if level not in fixed.ALERT_LEVELS:
        raise ValueError(f"unknown alert level: {level!r}")
    return F.col("alert_level").isin(fixed.ALERT_LEVELS[fixed.ALERT_LEVELS.index(level) :])


def query_alerts(
    alerts: DataFrame,
    device_serial: str | None = None,
    from_date: dt.date | str | None = None,
    to_date: dt.date | str | None = None,
    min_level: str | None = None,
    limit: int | None = None,
    notified_only: bool = False,
) -> DataFrame:
    """Newest alerts matching all given conditions; ``to_date`` includes its whole day."""
    if device_serial is not None:
        alerts = alerts.where(F.col("device_serial") == device_serial)
    if from_date is not None:
        alerts = alerts.where(F.col("timestamp") >= F.lit(str(from_date)).cast("timestamp"))
    if to_date is not None:
        after = F.date_add(F.lit(str(to_date)).cast("date"), 1).cast("timestamp")
        alerts = alerts.where(F.col("timestamp") < after)
    if min_level is not None:
        alerts = alerts.where(at_least(min_level))
    if notified_only:
        alerts = alerts.where("notified")
    return newest_first(alerts, "timestamp", limit)


def unnotified(alerts: DataFrame) -> DataFrame:
    return newest_first(alerts.where(~F.col("notified")), "timestamp")


def latest_status(alerts: DataFrame) -> DataFrame:
    """Newest alert rows per device; rows tied on the newest time are all kept.

    The newest time is an aggregate with map-side combining; the join back is on
    ``(device_serial, timestamp)``, so a device with a long history is not gathered."""
    newest = alerts.groupBy("device_serial").agg(F.max("timestamp").alias("timestamp"))
    return alerts.join(newest, ["device_serial", "timestamp"], "left_semi")


def score_history(
    alerts: DataFrame, now: dt.datetime | Column, days: int = 30, device_serial: str | None = None
) -> DataFrame:
    """Score rows of the last ``days`` days, oldest first per device."""
    now = now if isinstance(now, Column) else F.lit(now)
    floor = F.unix_micros(now) - F.lit(days * 86_400_000_000)
    recent = alerts.where(F.unix_micros("timestamp") >= floor)
    if device_serial is not None:
        recent = recent.where(F.col("device_serial") == device_serial)
    return recent.select("device_serial", "timestamp", "anomaly_score", "fleet_percentile").orderBy(
        "device_serial", "timestamp"
    )


def query_health(
    health: DataFrame, job_name: str | None = None, status: str | None = None, limit: int | None = None
) -> DataFrame:
    if job_name is not None:
        health = health.where(F.col("job_name") == job_name)
    if status is not None:
        health = health.where(F.col("status") == status)
    return newest_first(health, "timestamp", limit)


def query_work_orders(
    orders: DataFrame, device_reg: int | None = None, unmatched_only: bool = False
) -> DataFrame:
    if device_reg is not None:
        orders = orders.where(F.col("device_reg") == device_reg)
    if unmatched_only:
        orders = orders.where(~F.col("matched"))
    return orders.orderBy(F.desc("registered_date"), F.desc("work_order_id"))


def training_labels(labels: DataFrame) -> DataFrame:
    """Labels as training reads them."""
    return newest_first(labels, "date").select(
        "device_serial", "date", "event_type",
        F.col("work_order_id").alias("cmms_work_order"), "notes",
    )


def model_versions(models: DataFrame, active_only: bool = False) -> DataFrame:
    chosen = models.where("active") if active_only else models
    return chosen.orderBy(F.desc("trained_at"), F.desc("version_id"))


def row_id(*key: str) -> Column:
    """Stable id of an appended row."""
    return F.xxhash64(*key)


def alert_rows(summary: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Rows to append to the alert history: one per device per run."""
    now = now if isinstance(now, Column) else F.lit(now)
    stamped = summary.withColumn("timestamp", now)
    return stamped.select(
        row_id("device_serial", "timestamp").alias("id"),
        "device_serial",
        "timestamp",
        "alert_level",
        "anomaly_score",
        "fleet_percentile",
        F.lit(False).alias("notified"),
        F.lit(None).cast("timestamp").alias("notified_at"),
    )


def mark_notified(alerts: DataFrame, sent: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Alert table with the ``(device_serial, timestamp)`` rows of ``sent`` marked."""
    now = now if isinstance(now, Column) else F.lit(now)
    keys = sent.select("device_serial", "timestamp").distinct().withColumn("_sent", F.lit(True))
    hit = F.col("_sent").isNotNull()
    return (
        alerts.join(keys, ["device_serial", "timestamp"], "left")
        .withColumns(
            {
                "notified": F.col("notified") | hit,
                "notified_at": F.when(hit, now).otherwise(F.col("notified_at")),
            }
        )
        .select(*alerts.columns)
    )


def health_row(
    health: DataFrame, now: dt.datetime | Column, job_name: str, status: str,
    duration_ms: int = 0, error_message: str | None = None,
) -> DataFrame:
    """Log row of a job whose processed rows are those of ``health``."""
    now = now if isinstance(now, Column) else F.lit(now)
    return health.agg(F.count(F.lit(1)).alias("rows_processed")).select(
        now.alias("timestamp"),
        F.lit(job_name).alias("job_name"),
        F.lit(status).alias("status"),
        F.lit(duration_ms).cast("bigint").alias("duration_ms"),
        "rows_processed",
        F.lit(error_message).cast("string").alias("error_message"),
    )


def new_work_orders(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows of ``incoming`` whose id is not stored yet, one per id.

    Of several incoming rows with one id, the smallest in column order is kept (an aggregate,
    so a much-repeated id combines map-side)."""
    rest = [c for c in incoming.columns if c != "work_order_id"]
    once = incoming.groupBy("work_order_id").agg(F.min(F.struct(*rest)).alias("r"))
    fresh = once.join(existing.select("work_order_id"), "work_order_id", "left_anti")
    return fresh.select("work_order_id", *[F.col(f"r.{c}").alias(c) for c in rest])


def mark_matched(orders: DataFrame, done: DataFrame) -> DataFrame:
    keys = done.select("work_order_id").distinct().withColumn("_done", F.lit(True))
    return (
        orders.join(keys, "work_order_id", "left")
        .withColumn("matched", F.col("matched") | F.col("_done").isNotNull())
        .select(*orders.columns)
    )


def label_rows(matches: DataFrame, now: dt.datetime | Column, source: str = "auto") -> DataFrame:
    """Feedback labels to append from matched work orders."""
    now = now if isinstance(now, Column) else F.lit(now)
    return matches.select(
        row_id("device_serial", "work_order_id").alias("id"),
        "device_serial",
        "date",
        "event_type",
        "work_order_id",
        "matched_alert_id",
        F.lit("").alias("notes"),
        now.alias("created_at"),
        F.lit(source).alias("source"),
    )


def register_model(models: DataFrame, new: DataFrame) -> DataFrame:
    """Model table after registering ``new``: the new row is the only active one."""
    retired = models.withColumn("active", F.lit(False))
    return retired.unionByName(new.withColumn("active", F.lit(True)).select(*models.columns))


def latest_attribution(cache: DataFrame) -> DataFrame:
    """Newest cached attribution per device."""
    rest = [c for c in cache.columns if c != "device_serial"]
    newest = F.max_by(F.struct(*rest), F.struct("computed_at", "id"))
    return (
        cache.groupBy("device_serial")
        .agg(newest.alias("r"))
        .select("device_serial", *[F.col(f"r.{c}").alias(c) for c in rest])
    )


def attribution_todo(devices: DataFrame, cache: DataFrame) -> DataFrame:
    """Devices without a cached attribution."""
    return devices.select("device_serial").distinct().join(
        cache.select("device_serial").distinct(), "device_serial", "left_anti"
    )


def attribution_rows(result: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Cache rows to append; ``result`` has device, window bounds and a JSON text."""
    now = now if isinstance(now, Column) else F.lit(now)
    stamped = result.withColumn("computed_at", now)
    return stamped.select(
        row_id("device_serial", "computed_at").alias("id"),
        "device_serial",
        "computed_at",
        F.col("window_start").cast("string").alias("window_start"),
        F.col("window_end").cast("string").alias("window_end"),
        "result_json",
    )

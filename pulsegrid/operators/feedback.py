"""Work orders, label matching and learning summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid import fixed
from pulsegrid.dims import lookup
from pulsegrid.operators.state import newest_first


def order_type(raw: Column) -> Column:
    word = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    return F.coalesce(lookup(fixed.WORK_ORDER_TYPES, word), word)


def normalize_work_orders(raw: DataFrame) -> DataFrame:
    """Typed work orders from an export with internal column names; blank device rows drop."""
    day = lambda c: F.try_to_date(F.substring(F.col(c).cast("string"), 1, 10), "yyyy-MM-dd")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in raw.columns else F.lit("")
    return raw.where(F.col("device_reg").isNotNull()).select(
        F.col("work_order_id").cast("string").alias("work_order_id"),
        order_type(F.col("work_order_type")).alias("work_order_type"),
        day("registered_date").alias("registered_date"),
        day("completed_date").alias("completed_date"),
        text("fault_description").alias("fault_description"),
        text("technical_description").alias("technical_description"),
        F.col("device_reg").try_cast("int").alias("device_reg"),
        text("serial_number").alias("serial_number"),
    )


def resolve_device(df: DataFrame, registry: DataFrame, how: str = "left") -> DataFrame:
    """Add ``device_serial`` from the registration number (left keeps unknown devices)."""
    pairs = registry.select(F.col("cmms_reg").alias("device_reg"), "device_serial")
    return df.join(pairs, "device_reg", how)


def classify(kind: Column) -> Column:
    return F.coalesce(lookup(fixed.EVENT_OF_ORDER_TYPE, kind), F.lit("unrelated"))


def match_work_orders(
    orders: DataFrame, alerts: DataFrame, registry: DataFrame, days: int = 7, nearest: bool = False
) -> DataFrame:
    """Label each unmatched work order from alerts of its device within ``days`` either side.

    The latest warning-or-worse alert in the interval is linked (``nearest`` links the closest
    one). Alerts first shrink to one row per (device, day) and orders expand to the days of their
    interval, so the join is an equality join with at most one partner per key. Orders without
    alerts, without a date or of other types are "unrelated"; unknown devices are skipped.
    """
    pending = resolve_device(orders.where(~F.col("matched")), registry, "inner")
    newest = F.struct("timestamp", "id")
    per_day = (
        alerts.where(F.col("alert_level").isin("warning", "critical"))
        .groupBy("device_serial", F.to_date("timestamp").alias("day"))
        .agg(F.max(newest).alias("newest"), F.min(newest).alias("oldest"))
    )
    reg = F.col("registered_date")
    span = F.sequence(F.date_sub(reg, days), F.date_add(reg, days))
    hits = (
        pending.where(reg.isNotNull())
        .select("work_order_id", "device_serial", "registered_date", F.explode(span).alias("day"))
        .join(per_day, ["device_serial", "day"])
    )
    if nearest:
        gap = lambda a: F.abs(F.unix_micros(a["timestamp"]) - F.unix_micros(reg.cast("timestamp")))
        best = F.min_by(
            F.when(gap(F.col("oldest")) < gap(F.col("newest")), F.col("oldest.id")).otherwise(
                F.col("newest.id")
            ),
            F.least(gap(F.col("oldest")), gap(F.col("newest"))),
        )
    else:
        best = F.max_by(F.col("newest.id"), F.col("newest"))
    linked = hits.groupBy("work_order_id").agg(best.alias("matched_alert_id"))
    found = F.col("matched_alert_id").isNotNull()
    return pending.join(linked, "work_order_id", "left").select(
        "work_order_id",
        "device_serial",
        F.col("registered_date").alias("date"),
        F.when(found, classify(F.col("work_order_type"))).otherwise("unrelated").alias("event_type"),
        "matched_alert_id",
        found.alias("matched_alert"),
    )


def learning_summary(labels: DataFrame, since: DataFrame | None = None) -> DataFrame:
    """Label counts and whether a retrain is due (at least 10 labels, one confirmed fault).

    ``since`` holds the active model versions; then only labels newer than the newest count
    towards the retrain condition."""
    fault = F.col("event_type") == "confirmed_fault"
    fresh = F.lit(True)
    if since is not None:
        fresh = F.col("created_at") > since.where("active").select(F.max("trained_at")).scalar()
    return labels.agg(
        F.count(F.lit(1)).alias("total_labels"),
        F.count_if(fault).alias("confirmed_count"),
        ((F.count_if(fresh) >= 10) & (F.count_if(fresh & fault) >= 1)).alias("retrain_ready"),
    )


def reports_summary(alerts: DataFrame, labels: DataFrame, newest: int | None = None) -> DataFrame:
    """Counts over all alerts, or only the ``newest`` ones, and all labels."""
    recent = alerts if newest is None else newest_first(alerts, "timestamp", newest)
    label_counts = learning_summary(labels)
    pick = lambda c: label_counts.select(c).scalar()
    return recent.agg(
        F.count(F.lit(1)).alias("total_alerts"),
        F.count_if(F.col("alert_level").isin("warning", "critical")).alias("warning_plus"),
    ).select(
        "total_alerts",
        "warning_plus",
        pick("total_labels").alias("total_labels"),
        pick("confirmed_count").alias("confirmed_count"),
    )


def pipeline_status(health: DataFrame) -> DataFrame:
    """Traffic light from the newest inference run and the newest health check."""
    newest = lambda job: F.max_by(
        F.when(F.col("job_name") == job, F.col("status")),
        F.when(F.col("job_name") == job, F.struct("timestamp", "id")),
    )
    last = health.agg(
        newest("daily_inference").alias("inference"), newest("health_check").alias("check")
    )
    return last.select(
        F.when(F.col("inference").isNull(), "yellow")
        .when(F.col("inference") == "failure", "red")
        .when(F.col("check") == "failure", "yellow")
        .otherwise("green")
        .alias("status")
    )

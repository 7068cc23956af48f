"""Telemetry tables partitioned by day: writing, loading, manifest."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.operators.clean import clean_long, fleet_only
from pulsegrid.operators.evaluate import event_days


def write_daily(df: DataFrame, path: str) -> None:
    """Write (or rewrite only the touched days of) a table partitioned by ``day``.

    The rebalance step groups rows by day and device and lets adaptive execution split a busy
    day or device over several tasks; files are sorted so that device and variable predicates
    skip row groups."""
    (
        df.withColumn("day", F.to_date("timestamp"))
        .hint("rebalance", "day", "device_serial")
        .sortWithinPartitions("day", "device_serial", "variable_id", "timestamp")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )


def extract_daily(
    raw: DataFrame,
    path: str,
    registry: DataFrame | None = None,
    exclude_before: dt.date | str | None = "2025-11-17",
    end_date: dt.date | str | None = None,
    variable_ids: list[int] | None = None,
) -> None:
    """Clean the raw table and store it by day. Both dates are inclusive.

    Columns are typed before they are compared, so an unreadable time or variable is no match rather
    than an error; a column that has its type already is compared in the scan."""
    df = clean_long(raw)
    if exclude_before is not None:
        df = df.where(F.col("timestamp") >= F.lit(str(exclude_before)).cast("timestamp"))
    if end_date is not None:
        after = F.date_add(F.lit(str(end_date)).cast("date"), 1).cast("timestamp")
        df = df.where(F.col("timestamp") < after)
    if variable_ids is not None:
        df = df.where(F.col("variable_id").isin(list(variable_ids)))
    write_daily(df if registry is None else fleet_only(df, registry), path)


def load_fleet(spark: SparkSession, path: str) -> DataFrame:
    """All days; a missing or empty table is an error."""
    df = spark.read.parquet(path)
    if df.isEmpty():
        raise FileNotFoundError(f"no telemetry below {path}")
    return df


def load_recent(spark: SparkSession, path: str, now: dt.date, lookback_days: int = 1) -> DataFrame:
    """Days from ``now - (lookback+1)`` on; when there are none, the last ``lookback`` days."""
    df = spark.read.parquet(path)
    cutoff = now - dt.timedelta(days=lookback_days + 1)
    recent = df.where(F.col("day") >= F.lit(cutoff))
    if not recent.isEmpty():
        return recent
    days = df.select("day").distinct().orderBy(F.desc("day")).limit(lookback_days)
    return df.join(days, "day", "left_semi")


def load_event_span(
    telemetry: DataFrame, events: DataFrame, pre_days: int = 14, post_days: int = 2
) -> DataFrame:
    """Rows of each event's device on the days ``date-pre-1`` to ``date+post+1``."""
    spans = event_days(events, -pre_days - 1, post_days + 1)
    return telemetry.join(
        spans.select("event_id", "device_serial", "day", "cmms_reg", "event_date"),
        ["device_serial", "day"],
    )


def union_days(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def manifest(
    stored: DataFrame,
    registry: DataFrame,
    exclude_before: str | None = "2025-11-17",
    variable_ids: list[int] | None = None,
) -> DataFrame:
    """One row: stored rows, days, bounds of the extract, fleet size, variable count."""
    fleet = registry.select(F.count(F.lit(1))).scalar()
    return stored.agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_distinct("day").alias("n_chunks")
    ).select(
        "total_rows",
        "n_chunks",
        F.lit(exclude_before).cast("string").alias("exclude_before"),
        fleet.alias("fleet_size"),
        F.lit(str(len(variable_ids)) if variable_ids else "all").alias("n_variable_ids"),
    )

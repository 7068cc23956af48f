"""Long-table operators: cleaning, fleet membership, scans."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, functions as F


def number(value: Column) -> Column:
    """Text to double; unreadable text and NaN become null."""
    parsed = value.try_cast("double")
    return F.when(F.isnan(parsed), None).otherwise(parsed)


def clean_long(raw: DataFrame, registry: DataFrame | None = None) -> DataFrame:
    """Typed long telemetry, restricted to the fleet when a registry is given."""
    typed = {
        "timestamp": F.col("timestamp").try_cast("timestamp"),
        "value": number(F.col("value").cast("string")),
        "variable_id": number(F.col("variable_id").cast("string")).cast("int"),
    }
    typed |= {
        c: F.col(c).cast("tinyint") for c in raw.columns if c.startswith("bitfield_")
    }
    cleaned = raw.withColumns({c: e for c, e in typed.items() if c in raw.columns})
    return cleaned if registry is None else fleet_only(cleaned, registry)


def fleet_only(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of registered devices (semi join; broadcast only if Spark finds the registry small)."""
    return df.join(registry.select("device_serial"), "device_serial", "left_semi")


def unknown_devices(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Distinct serials that no registry row covers.

    The distinct runs first, so the anti join sees one row per serial."""
    return df.select("device_serial").distinct().join(
        registry.select("device_serial"), "device_serial", "left_anti"
    )


def scan_range(
    df: DataFrame,
    start: dt.date | str | None = None,
    end: dt.date | str | None = None,
    devices: list[str] | None = None,
    variables: list[int] | None = None,
    ordered: bool = False,
) -> DataFrame:
    """Half-open time range with optional device and variable lists; ``ordered`` sorts the whole
    result by time.

    All predicates are plain column comparisons and reach the file scan."""
    if start is not None:
        df = df.where(F.col("timestamp") >= F.lit(str(start)).cast("timestamp"))
    if end is not None:
        df = df.where(F.col("timestamp") < F.lit(str(end)).cast("timestamp"))
    if devices is not None:
        df = df.where(F.col("device_serial").isin(devices))
    if variables is not None:
        df = df.where(F.col("variable_id").isin(variables))
    return df.orderBy("timestamp") if ordered else df


def time_range(df: DataFrame) -> DataFrame:
    return df.agg(F.min("timestamp").alias("min_ts"), F.max("timestamp").alias("max_ts"))

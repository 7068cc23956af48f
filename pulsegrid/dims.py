"""Small dimension tables built from the fixed values.

Each has at most a few hundred rows whatever the telemetry volume, so joins against them may
carry a broadcast hint. Site tables that grow (a registry export, a full label catalog) are
passed in as ordinary DataFrames and left to Spark's size-based join choice.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pulsegrid import fixed
from pulsegrid.functions.text import normalize_serial


def variables(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        fixed.VARIABLES, "id INT, name STRING, unit STRING, tier INT, description STRING"
    )


def status_bits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.STATUS_BITS, "variable_id INT, bit INT, name STRING")


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(fixed.LABELS, "variable_id STRING, label STRING, unit STRING")


def codes(spark: SparkSession) -> DataFrame:
    rows = [(v, c, text) for v, table in fixed.CODED_VALUES.items() for c, text in table.items()]
    return spark.createDataFrame(rows, "variable_id STRING, code STRING, text STRING")


def units(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(fixed.UNIT_CODES.items()), "code STRING, unit STRING")


def registry(spark: SparkSession, source: DataFrame | None = None) -> DataFrame:
    """Fleet registry ``(device_serial, cmms_reg, cmms_serial)``.

    ``source`` is a maintenance export with ``cmms_reg`` and ``cmms_serial``; the fixed fleet is
    used without one.
    """
    if source is None:
        source = spark.createDataFrame(fixed.FLEET, "cmms_reg INT, cmms_serial STRING")
    return source.select(
        normalize_serial(F.col("cmms_serial")).alias("device_serial"), "cmms_reg", "cmms_serial"
    )


def failures(spark: SparkSession) -> DataFrame:
    """Known failures: one row per event id."""
    rows = [
        (i, reg, dt.date.fromisoformat(day), text, code)
        for i, (reg, day, text, code) in enumerate(fixed.KNOWN_FAILURES, 1)
    ]
    events = spark.createDataFrame(
        rows, "event_id INT, cmms_reg INT, event_date DATE, description STRING, fault_code STRING"
    )
    return events.join(F.broadcast(registry(spark)), "cmms_reg").select(
        "event_id", "device_serial", "cmms_reg", "event_date", "description", "fault_code"
    )


def services(spark: SparkSession) -> DataFrame:
    """Scheduled services: one row per event id."""
    rows = [
        (i, reg, dt.date.fromisoformat(day)) for i, (reg, day) in enumerate(fixed.SERVICES, 1)
    ]
    events = spark.createDataFrame(rows, "event_id INT, cmms_reg INT, event_date DATE")
    return events.join(F.broadcast(registry(spark)), "cmms_reg").select(
        "event_id", "device_serial", "cmms_reg", "event_date"
    )


def lookup(table: dict[str, str], key: Column) -> Column:
    """Value of a short constant map, null when the key is absent."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)

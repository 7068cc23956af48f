"""State tables as versioned Parquet folders, work-order import, CSV export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid import fixed
from pulsegrid.operators.feedback import normalize_work_orders, resolve_device
from pulsegrid.operators.state import newest_first
from pulsegrid.session import scratch_path


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_rows(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def new_version(df: DataFrame, label: str) -> str:
    """Write a whole new version of a table beside the old one and return its path.

    The path being read is never overwritten; the caller switches to the returned path."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return path


def read_work_orders(spark: SparkSession, path: str, registry: DataFrame) -> DataFrame:
    """Work orders from a headed CSV export; unknown registration numbers keep a null device."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    named = {h.strip(): h for h in raw.columns}
    present = [(named[h], name) for h, name in fixed.WORK_ORDER_HEADERS.items() if h in named]
    renamed = raw.select(*[F.col(f"`{h}`").alias(name) for h, name in present])
    return resolve_device(normalize_work_orders(renamed), registry, "left")


def export_csv(df: DataFrame, path: str, by: str | None = None, limit: int | None = None) -> None:
    """Headed CSV folder; with ``limit`` only the newest rows by ``by``."""
    out = df if by is None else newest_first(df, by, limit)
    out.write.option("header", True).option("escape", '"').csv(path)

"""Named queries: a Spark callable and, where SQL can say the same, its SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.workloads.adapter import tidy

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(
    name: str, sql: str | None = None, dates: tuple[str, ...] = (), exact: bool = False
) -> Callable[[Query], Query]:
    """Register a query. ``dates`` are shown as text on both sides; ``exact`` leaves doubles
    unrounded (for results without sums)."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir), None if exact else 6)
        if sql is not None:
            shown = ", ".join(f"CAST({d} AS VARCHAR) AS {d}" for d in dates)
            SQL[name] = f"SELECT * REPLACE ({shown}) FROM (\n{sql}\n)" if dates else sql
        return fn

    return register

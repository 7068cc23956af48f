import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, compare

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "resample_pivot_bits", "window_stats", "daily_inference", "evaluate_model", "pv_eval",
    "match_work_orders", "telemetry_rows", "stream_alerts", "xai_summary", "extract_daily",
]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 110


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toPandas()
    assert compare(name, got, con.execute(entry.oracle_sql()[name]).df()) == ""
    assert len(got)

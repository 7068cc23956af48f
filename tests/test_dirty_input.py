"""Unreadable, infinite and awkward input."""

import math

from pyspark.sql import functions as F

from pulsegrid import dims, fixed
from pulsegrid.functions.quantiles import exact_quantiles
from pulsegrid.models.linear_svm import subsample
from pulsegrid.operators import feedback, state
from pulsegrid.session import scratch_path
from pulsegrid.sources import tables, telemetry
from pulsegrid.operators.rank import fleet_percentile
from pulsegrid.operators.scaling import impute, medians


def test_label_catalog_is_complete(spark):
    assert len(fixed.LABELS) == len({i for i, _, _ in fixed.LABELS}) == 214
    got = {r.variable_id: r.label for r in dims.labels(spark).collect()}
    assert got["1131208"] == "Pressure Limitation Alarm" and got["2122"] == "Device Hardware Error"


def test_quantiles_with_infinities_and_nan(spark):
    rows = [(float(x), float("nan")) for x in range(-50, 51)] + [(math.inf, 1.0), (-math.inf, None), (None, math.inf)]
    df = spark.createDataFrame(rows, "a double, b double")
    for small in (5, 1000):
        assert exact_quantiles(df, ["a", "b"], 0.5, small)["a"] == 0.0
        assert exact_quantiles(df, ["a"], 0.0, small)["a"] == -math.inf
        assert exact_quantiles(df, ["a"], 1.0, small)["a"] == math.inf
        assert exact_quantiles(df.where("b = 1.0"), ["b"], 0.5, small)["b"] == 1.0


def test_extract_daily_survives_unreadable_cells(spark):
    raw = spark.createDataFrame(
        [("2025-12-01 00:00:00", "a", "635", "1.5"), ("not a time", "a", "635", "1.0"), ("2025-12-01 00:01:00", "a", "x", "2")],
        "timestamp string, device_serial string, variable_id string, value string",
    )
    path = scratch_path(spark, "daily")
    telemetry.extract_daily(raw, path, variable_ids=[635])
    assert [r.value for r in spark.read.parquet(path).collect()] == [1.5]


def test_csv_keeps_line_breaks_and_quotes(spark):
    text = 'first "line"\nsecond, line'
    path = scratch_path(spark, "csv")
    tables.export_csv(spark.createDataFrame([("1", text)], "id string, note string"), path)
    back = spark.read.csv(path, header=True, multiLine=True, escape='"').collect()
    assert [tuple(r) for r in back] == [("1", text)]


def test_work_order_with_line_break_is_read_back(spark):
    heads = {v: k for k, v in fixed.WORK_ORDER_HEADERS.items()}
    row = {h: "" for h in heads.values()}
    row[heads["work_order_id"]], row[heads["device_reg"]] = "77", "18839"
    row[heads["fault_description"]] = 'alarm "x"\nagain'
    path = scratch_path(spark, "orders")
    tables.export_csv(spark.createDataFrame([row]), path)
    got = tables.read_work_orders(spark, path, dims.registry(spark)).collect()
    assert [r.work_order_id for r in got] == ["77"] and "again" in got[0].fault_description


def test_subsample_has_the_wanted_number_at_every_size(spark):
    df = spark.range(500).select(
        F.col("id").cast("string").alias("device_serial"), F.lit(0).cast("timestamp").alias("window_start"), "id"
    )
    for n in (1, 7, 499, 500, 900):
        assert subsample(df, n, 3).count() == min(n, 500)
    assert {r.id for r in subsample(df, 7, 3).collect()} < {r.id for r in subsample(df, 50, 3).collect()}


def test_summaries_count_everything(spark):
    alerts = spark.range(1500).selectExpr("id", "timestamp_seconds(id) timestamp", "'warning' alert_level")
    labels = spark.createDataFrame([], "event_type string, created_at timestamp")
    assert feedback.reports_summary(alerts, labels).first().total_alerts == 1500
    assert feedback.reports_summary(alerts, labels, newest=10).first().total_alerts == 10
    assert state.newest_first(alerts, "timestamp").count() == 1500


def test_a_score_that_is_no_number_has_no_rank(spark):
    rows = [("a", 1.0), ("b", 2.0), ("c", float("nan")), ("d", None)]
    scores = spark.createDataFrame(rows, "device_serial string, anomaly_score double").selectExpr(
        "*", "timestamp'2025-12-01 00:00:00' as timestamp"
    )
    got = {r.device_serial: r.fleet_percentile for r in fleet_percentile(scores).collect()}
    assert got == {"a": 0.5, "b": 1.0, "c": None, "d": None}


def test_an_infinite_median_is_imputed(spark):
    df = spark.createDataFrame([(float("inf"),), (float("inf"),), (None,)], "x double")
    filled = impute(df, medians(df, ["x"])).collect()
    assert [r.x for r in filled] == [float("inf")] * 3

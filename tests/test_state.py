import datetime as dt

import pytest

from pulsegrid.operators import feedback as fb
from pulsegrid.operators import state
from pulsegrid.session import scratch_path
from pulsegrid.sources import tables, telemetry
from pulsegrid import dims, fixed, schemas

NOW = dt.datetime(2026, 4, 30)


def day(n, month=4):
    return dt.datetime(2026, month, n)


def alerts(spark, *rows):
    full = [(i, d, t, level, 1.0, 0.9, n, None) for i, (d, t, level, n) in enumerate(rows, 1)]
    return spark.createDataFrame(full, schemas.ALERT_HISTORY)


def test_alert_queries(spark):
    df = alerts(spark, ("a", day(1), "normal", False), ("a", day(5), "critical", True), ("b", day(10), "warning", False))
    assert state.query_alerts(df, device_serial="a").count() == 2
    assert [r.id for r in state.query_alerts(df, from_date="2026-04-03", to_date="2026-04-07").collect()] == [2]
    assert [r.id for r in state.query_alerts(df, to_date="2026-04-05").collect()] == [2, 1]
    assert state.query_alerts(df, min_level="warning").count() == 2
    assert [r.id for r in state.query_alerts(df, limit=1).collect()] == [3]
    assert [r.id for r in state.unnotified(df).collect()] == [3, 1]
    with pytest.raises(ValueError):
        state.query_alerts(df, min_level="unknown")


def test_latest_status_keeps_ties(spark):
    df = alerts(spark, ("a", day(1), "normal", False), ("a", day(5), "critical", False),
                ("b", day(3), "normal", False), ("b", day(3), "warning", False))
    got = sorted((r.device_serial, r.alert_level) for r in state.latest_status(df).collect())
    assert got == [("a", "critical"), ("b", "normal"), ("b", "warning")]


def test_score_history(spark):
    df = alerts(spark, ("a", day(29), "normal", False), ("a", dt.datetime(2020, 1, 1), "normal", False))
    assert state.score_history(df, NOW, 30).count() == 1


def test_mark_notified_and_versions(spark):
    df = alerts(spark, ("a", day(1), "warning", False), ("b", day(1), "warning", False))
    marked = state.mark_notified(df, df.where("device_serial = 'a'"), NOW)
    path = tables.new_version(marked, "alerts")
    rows = {r.device_serial: r for r in tables.read_table(spark, path, schemas.ALERT_HISTORY).collect()}
    assert rows["a"].notified and rows["a"].notified_at == NOW
    assert not rows["b"].notified and rows["b"].notified_at is None


def orders(spark, *rows):
    full = [(w, kind, d, None, "", "", reg, "", "f", NOW, done) for w, kind, d, reg, done in rows]
    return spark.createDataFrame(full, schemas.WORK_ORDERS)


def test_label_matching(spark):
    serial = "000000008204570"
    df = orders(
        spark,
        ("1", "corrective", dt.date(2026, 1, 9), 18839, False),
        ("2", "preventive", dt.date(2025, 12, 8), 18839, False),
        ("3", "corrective", dt.date(2026, 6, 1), 18839, False),
        ("4", "corrective", None, 18839, False),
        ("5", "corrective", dt.date(2026, 1, 9), 1, False),
        ("6", "corrective", dt.date(2026, 1, 9), 18839, True),
    )
    history = alerts(
        spark,
        (serial, dt.datetime(2026, 1, 7), "warning", False),
        (serial, dt.datetime(2026, 1, 16, 23), "critical", False),
        (serial, dt.datetime(2026, 1, 17), "critical", False),
        (serial, dt.datetime(2025, 12, 7), "warning", False),
        (serial, dt.datetime(2026, 6, 1), "normal", False),
    )
    got = {r.work_order_id: r for r in fb.match_work_orders(df, history, dims.registry(spark)).collect()}
    assert {k: (v.event_type, v.matched_alert_id) for k, v in got.items()} == {
        "1": ("confirmed_fault", 2), "2": ("scheduled_pv", 4), "3": ("unrelated", None), "4": ("unrelated", None),
    }
    near = fb.match_work_orders(df, history, dims.registry(spark), nearest=True)
    assert {r.work_order_id: r.matched_alert_id for r in near.collect()}["1"] == 1
    labels = state.label_rows(fb.match_work_orders(df, history, dims.registry(spark)), NOW).collect()
    assert {r.source for r in labels} == {"auto"} and len(labels) == 4
    marked = state.mark_matched(df, spark.createDataFrame([("1",)], "work_order_id string"))
    assert {r.work_order_id for r in marked.where("matched").collect()} == {"1", "6"}


def test_work_order_import(spark):
    header = list(fixed.WORK_ORDER_HEADERS)
    rows = [
        ("7", " Korrektiv ", "2026-01-09 10:00:00", None, "sensor", None, "18839", "S"),
        ("8", "Forebyggende", "2026-01-10", "bad", None, None, "99", None),
        ("9", "Annet", None, None, None, None, None, None),
    ]
    path = scratch_path(spark, "csv")
    tables.export_csv(spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in header)), path)
    got = {r.work_order_id: r for r in tables.read_work_orders(spark, path, dims.registry(spark)).collect()}
    assert set(got) == {"7", "8"}
    assert got["7"].work_order_type == "corrective" and got["7"].registered_date == dt.date(2026, 1, 9)
    assert got["7"].device_serial == "000000008204570" and got["8"].device_serial is None
    assert got["8"].work_order_type == "preventive" and got["8"].completed_date is None


def test_new_work_orders_ignores_known_and_repeated(spark):
    incoming = orders(spark, ("1", "a", None, 1, False), ("2", "b", None, 1, False), ("2", "a", None, 1, False))
    fresh = state.new_work_orders(incoming, orders(spark, ("1", "x", None, 1, False))).collect()
    assert [(r.work_order_id, r.work_order_type) for r in fresh] == [("2", "a")]


def test_model_registration_and_learning(spark):
    models = spark.createDataFrame([(1, day(1), 1, 0, "p", None, True)], schemas.MODEL_VERSIONS)
    new = spark.createDataFrame([(2, day(2), 9, 2, "q", None)], "version_id long, trained_at timestamp, label_count int, confirmed_count int, model_path string, performance_snapshot string")
    after = state.register_model(models, new)
    assert [r.version_id for r in state.model_versions(after, active_only=True).collect()] == [2]
    labels = spark.createDataFrame(
        [(i, "a", day(1).date(), "confirmed_fault" if i == 0 else "unrelated", str(i), None, "", day(i + 1), "auto") for i in range(10)],
        schemas.FEEDBACK_LABELS,
    )
    assert fb.learning_summary(labels).first().retrain_ready
    assert not fb.learning_summary(labels.limit(9)).first().retrain_ready
    assert not fb.learning_summary(labels, since=after).first().retrain_ready


@pytest.mark.parametrize("rows,light", [
    ([], "yellow"), ([("daily_inference", "failure")], "red"),
    ([("daily_inference", "failure"), ("daily_inference", "success")], "green"),
    ([("daily_inference", "success"), ("health_check", "failure")], "yellow"),
])
def test_pipeline_status(spark, rows, light):
    full = [(i, day(i + 1), job, status, 0, 0, None) for i, (job, status) in enumerate(rows)]
    assert fb.pipeline_status(spark.createDataFrame(full, schemas.SYSTEM_HEALTH)).first().status == light


def test_attribution_cache(spark):
    rows = [(1, "a", day(1), "", "", "old"), (2, "a", day(2), "", "", "new")]
    cache = spark.createDataFrame(rows, schemas.ATTRIBUTION_CACHE)
    assert [r.result_json for r in state.latest_attribution(cache).collect()] == ["new"]
    devices = spark.createDataFrame([("a",), ("b",), ("b",)], "device_serial string")
    assert [r[0] for r in state.attribution_todo(devices, cache).collect()] == ["b"]


def test_daily_table_rewrites_only_touched_days(spark):
    schema = "timestamp timestamp, device_serial string, variable_id int, value double"
    path = scratch_path(spark, "daily")
    telemetry.write_daily(spark.createDataFrame([(day(1), "a", 1, 1.0), (day(2), "a", 1, 2.0)], schema), path)
    telemetry.write_daily(spark.createDataFrame([(day(2), "a", 1, 3.0)], schema), path)
    assert sorted(r.value for r in telemetry.load_fleet(spark, path).collect()) == [1.0, 3.0]
    assert [r.value for r in telemetry.load_recent(spark, path, day(3).date(), 0).collect()] == [3.0]
    late = telemetry.load_recent(spark, path, dt.date(2030, 1, 1), 1)
    assert [r.value for r in late.collect()] == [3.0]

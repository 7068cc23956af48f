import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import alerts as al
from pulsegrid.operators import evaluate as ev
from pulsegrid.operators import rank

START = dt.datetime(2025, 12, 1)
STEP = dt.timedelta(minutes=5)


def table(spark, per_device):
    rows = []
    for device, values in per_device.items():
        for i, v in enumerate(values):
            end = START + i * STEP
            v = None if v is None else float(v)
            rows.append((device, end - 5 * STEP, end, end, v, v))
    return spark.createDataFrame(
        rows,
        "device_serial string, window_start timestamp, window_end timestamp, timestamp timestamp, "
        "anomaly_score double, fleet_percentile double",
    )


def registry(spark):
    return spark.createDataFrame([("a", 1)], "device_serial string, cmms_reg int")


def test_percentile_matches_average_rank(spark):
    rng = np.random.default_rng(0)
    values = np.round(rng.normal(0, 2, (40, 30)), 1)
    values[rng.random(values.shape) < 0.1] = np.nan
    values[0, :] = 3.0
    rows = [
        (f"d{d}", START + t * STEP, None if np.isnan(values[d, t]) else float(values[d, t]))
        for d in range(40) for t in range(30)
    ]
    df = spark.createDataFrame(rows, "device_serial string, timestamp timestamp, anomaly_score double")
    got = rank.fleet_percentile(df).toPandas()
    want = got.groupby("timestamp")["anomaly_score"].rank(pct=True)
    np.testing.assert_allclose(got["fleet_percentile"], want)


def test_lone_device_and_minimum_fleet(spark):
    df = table(spark, {"a": [0.5, -1e-300, 0.0]}).drop("fleet_percentile")
    assert {r.fleet_percentile for r in rank.fleet_percentile(df).collect()} == {1.0}
    few = rank.fleet_percentile(df, min_fleet=2).collect()
    assert {r.fleet_percentile for r in few} == {None}


@pytest.mark.parametrize("slice", ["15min", "1d"])
def test_runs_across_slices(spark, slice):
    df = table(spark, {"a": [0, 0.96, 0.97, 0, 0.96, 0.96, 0.96], "b": [0.99] * 9, "c": [None, 0.2]})
    runs = rank.run_table(rank.threshold_runs(df, slice=slice)).toPandas()
    got = sorted((r.device_serial, r.n_windows) for r in runs.itertuples())
    assert got == [("a", 2), ("a", 3), ("b", 9)]
    last = runs[(runs.device_serial == "a") & (runs.n_windows == 3)].iloc[0]
    assert last.run_end == START + 6 * STEP and last.run_start == START + 4 * STEP - 5 * STEP


def test_alert_levels(spark):
    df = table(
        spark,
        {"a": [0.96, 0.97, 0.96, 0.1, 0.99, 0.96, 0.96], "b": [0.99, 0.99, 0.1], "c": [0.95, 0.95, 0.95]},
    )
    rows = al.sustained_alerts(df, registry(spark), slice="15min").collect()
    got = sorted((r.device_serial, r.alert_level, r.n_anomalous_windows) for r in rows)
    assert got == [("a", "critical", 3), ("a", "warning", 3), ("b", "normal", 0), ("c", "warning", 3)]
    normal = next(r for r in rows if r.device_serial == "b")
    assert normal.alert_start is None and normal.top_contributing_features == ""
    assert normal.fleet_percentile == 0.99 and normal.cmms_reg is None
    assert {r.cmms_reg for r in rows if r.device_serial == "a"} == {1}
    summary = {r.device_serial: r.alert_level for r in al.run_summary(df, al.sustained_alerts(df, registry(spark))).collect()}
    assert summary == {"a": "warning", "b": "normal", "c": "warning"}


def test_cooldown_and_digest(spark):
    df = table(spark, {"a": [0.96] * 3, "b": [0.99] * 3})
    alerts = al.sustained_alerts(df, registry(spark))
    now = dt.datetime(2025, 12, 2)
    history = spark.createDataFrame(
        [(1, "a", START, "warning", True, now - dt.timedelta(hours=3)),
         (2, "b", START, "warning", True, now - dt.timedelta(hours=30))],
        "id long, device_serial string, timestamp timestamp, alert_level string, notified boolean, notified_at timestamp",
    )
    sent = al.digest(al.cooldown(alerts, history, now)).collect()
    assert [r.device_serial for r in sent] == ["b"]
    assert sent[0].subject == "PdM Alert — 1 device requires attention"
    assert "CRITICAL (fleet percentile: 99%)" in sent[0].block
    assert "http://localhost:8000/device/b" in sent[0].block
    both = al.digest(alerts).collect()
    assert {r.subject for r in both} == {"PdM Alert — 2 devices requires attention"}
    assert any("Device 1 — WARNING" in r.block for r in both)


def events(spark, *rows):
    return spark.createDataFrame(
        list(rows), "event_id int, device_serial string, cmms_reg int, event_date date, description string"
    )


def test_lead_time_and_missing_events(spark):
    day = dt.date(2025, 12, 2)
    quiet, loud = [0.1] * 12, [0.97] * 4
    df = table(spark, {"a": quiet + loud + quiet, "b": quiet})
    known = events(spark, (1, "a", 1, day, "x"), (2, "b", 2, day, "y"), (3, "z", 3, day, "none"))
    rows = {r.event_id: r for r in ev.evaluate_model(df, known, "m").collect()}
    assert rows[1].detected and rows[1].lead_time_days == pytest.approx(1 - 60 / 1440)
    assert rows[1].n_score_points == 28 and rows[1].max_percentile_pre == 0.97
    assert not rows[2].detected and rows[2].lead_time_days is None and rows[2].n_score_points == 12
    assert not rows[3].detected and rows[3].n_score_points == 0
    compared = ev.model_comparison([ev.evaluate_model(df, known, "m")]).first()
    assert compared.events_detected == "1/3"


def test_event_window_includes_both_ends(spark):
    day = dt.date(2025, 12, 15)
    at = dt.datetime(2025, 12, 15)
    times = [at - dt.timedelta(days=14), at + dt.timedelta(days=2), at + dt.timedelta(days=2, seconds=1),
             at - dt.timedelta(days=14, seconds=1)]
    df = spark.createDataFrame([("a", t, 1.0) for t in times], "device_serial string, timestamp timestamp, anomaly_score double")
    got = ev.event_windows(df, events(spark, (1, "a", 1, day, "")))
    assert sorted(r.days_to_event for r in got.collect()) == [-14.0, 2.0]


def test_service_control(spark):
    rng = np.random.default_rng(2)
    values = {f"d{i}": list(rng.normal(0, 1, 50)) for i in range(20)}
    values["hot"] = [9.0] * 50
    df = table(spark, values)
    services = spark.createDataFrame(
        [(1, "hot", 1, dt.date(2025, 12, 2)), (2, "d1", 2, dt.date(2025, 12, 2)), (3, "none", 3, dt.date(2025, 12, 2))],
        "event_id int, device_serial string, cmms_reg int, event_date date",
    )
    rows = {r.event_id: r for r in ev.service_control(df, services).collect()}
    every = pd.Series(np.concatenate([np.array(v) for v in values.values()]))
    assert rows[1].zscore_vs_fleet == pytest.approx((9 - every.mean()) / every.std())
    assert rows[1].elevated and rows[1].n_points == 50 and not rows[2].elevated
    assert rows[3].mean_score_pre is None and rows[3].elevated is None and rows[3].n_points == 0


def test_empty_scores(spark):
    df = table(spark, {"a": [0.5]}).where("false")
    assert al.sustained_alerts(df, registry(spark)).count() == 0
    assert rank.fleet_percentile(df).select(F.count("*")).first()[0] == 0

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.grid import grid_seconds, seconds
from pulsegrid.operators import align, clean

START = dt.datetime(2025, 12, 1)


def series_by_hand(long, freq, limit):
    """Bin means per series, carried forward inside the series' own range, in plain Python."""
    cells, bits = {}, {}
    for device, rows in long.groupby("device_serial"):
        wide = {}
        for vid, part in rows.groupby("variable_id"):
            bins = (part["timestamp"].astype("datetime64[s]").astype("int64") // freq)
            means = part["value"].groupby(bins).mean()
            last, age = None, None
            for b in range(bins.min(), bins.max() + 1):
                v = means.get(b, np.nan)
                if not np.isnan(v):
                    last, age = v, 0
                elif last is not None:
                    age += 1
                    v = last if age <= limit else np.nan
                wide.setdefault(b, {})[vid] = v
        cells.update({(device, b): row for b, row in wide.items()})
    return cells


def random_long(seed, devices=4, rows=120, holes=True):
    rng = np.random.default_rng(seed)
    out = []
    for d in range(devices):
        at = np.sort(rng.integers(0, 6 * 3600, rows))
        if holes:
            at = at[(at < 7000) | (at > 15000)]
        for t in at:
            vid = int(rng.choice([635, 2782, 1889]))
            value = None if rng.random() < 0.1 else float(rng.normal())
            out.append((START + dt.timedelta(seconds=int(t)), f"d{d}", vid, value))
    return pd.DataFrame(out, columns=["timestamp", "device_serial", "variable_id", "value"])


@pytest.mark.parametrize("slice_bins", [3, 7, 1440])
@pytest.mark.parametrize("gap", ["1min", "5min", "30min"])
def test_resample_then_pivot_matches_plain_python(spark, slice_bins, gap):
    long = random_long(seed=len(gap) + slice_bins)
    df = spark.createDataFrame(
        long, "timestamp timestamp, device_serial string, variable_id int, value double"
    )
    got = align.resample_then_pivot(
        df, "5min", gap, [635, 2782, 1889], [], slice_bins=slice_bins
    ).toPandas()
    want = series_by_hand(long, 300, seconds(gap) // 300)
    assert len(got) == len(want)
    for r in got.to_dict("records"):
        row = want[(r["device_serial"], int(r["timestamp"].timestamp()) // 300)]
        for vid in (635, 2782, 1889):
            assert r[f"var_{vid}"] == pytest.approx(row.get(vid, np.nan), nan_ok=True)


def test_multi_rate_alignment(spark):
    rng = np.random.default_rng(1)
    rows = [(START + dt.timedelta(seconds=58 * i), "a", 635, 35 + rng.normal(0, 0.5)) for i in range(60)]
    rows += [(START + dt.timedelta(seconds=22 * i), "a", 2782, 35.0) for i in range(160)]
    df = spark.createDataFrame(
        rows, "timestamp timestamp, device_serial string, variable_id int, value double"
    )
    wide = align.resample_then_pivot(df, "1min", "5min", [635, 2782], []).toPandas()
    both = wide["var_635"].notna() & wide["var_2782"].notna()
    assert both.mean() > 0.9
    assert (wide["var_635"] - wide["var_2782"]).abs().mean() < 2


def test_status_or_and_fill(spark):
    df = spark.createDataFrame(
        [
            (START, "a", 635, 1.0, True), (START, "a", 801, 2.0, False),
            (START + dt.timedelta(minutes=2), "a", 635, 1.0, None),
        ],
        "timestamp timestamp, device_serial string, variable_id int, value double, bitfield_x boolean",
    )
    rows = align.resample_then_pivot(df, "1min", "1min", [635]).orderBy("timestamp").collect()
    assert [r.bitfield_x for r in rows] == [1.0, 1.0, None]
    assert [r.var_635 for r in rows] == [1.0, 1.0, 1.0]


def test_status_of_variables_not_asked_for(spark):
    """Status words arrive in rows of their own variables; those rows make no grid rows themselves."""
    at = lambda m: START + dt.timedelta(minutes=m)
    df = spark.createDataFrame(
        [(at(0), "a", 635, 1.0, None), (at(1), "a", 801, 2.0, True), (at(3), "a", 635, 1.0, None),
         (at(9), "a", 801, 0.0, True), (at(0), "b", 801, 2.0, True)],
        "timestamp timestamp, device_serial string, variable_id int, value double, bitfield_x boolean",
    )
    rows = align.resample_then_pivot(df, "1min", "1min", [635]).orderBy("timestamp").collect()
    assert [(r.device_serial, r.var_635, r.bitfield_x) for r in rows] == [
        ("a", 1.0, None), ("a", 1.0, 1.0), ("a", None, 1.0), ("a", 1.0, None)
    ]


@pytest.mark.parametrize("gap", ["0min", "3min", "90min"])
def test_status_bits_match_plain_python(spark, gap):
    """Each flag is carried by itself, packed (short gaps) or column by column, past slice borders."""
    rng, limit, rows = np.random.default_rng(5), seconds(gap) // 60, []
    flags = [f"bitfield_{i}" for i in range(70)]
    for i in sorted(rng.choice(300, 60, replace=False)):
        bits = [None if rng.random() < 0.7 else bool(rng.random() < 0.5) for _ in flags]
        rows.append((START + dt.timedelta(minutes=int(i)), "a", int(rng.choice([635, 801])), 1.0, *bits))
    schema = "timestamp timestamp, device_serial string, variable_id int, value double, "
    df = spark.createDataFrame(rows, schema + ", ".join(f"{c} boolean" for c in flags))
    got = align.resample_then_pivot(df, "1min", gap, [635], flags, slice_bins=7).toPandas()
    values = [r for r in rows if r[2] == 635]
    assert len(got) == (values[-1][0] - values[0][0]).seconds // 60 + 1
    for r in got.to_dict("records"):
        for p, c in enumerate(flags):
            known = [x for x in rows if x[0] <= r["timestamp"] and x[4 + p] is not None]
            age = (r["timestamp"] - known[-1][0]).total_seconds() / 60 if known else np.inf
            want = float(known[-1][4 + p]) if age <= limit else np.nan
            assert r[c] == pytest.approx(want, nan_ok=True)


def test_pivot_and_derived(spark):
    df = spark.createDataFrame(
        [(START, "a", 635, 0.36), (START, "a", 2782, 0.40), (START, "a", 635, None),
         (START + dt.timedelta(minutes=1), "a", 635, None)],
        "timestamp timestamp, device_serial string, variable_id int, value double",
    )
    wide = align.derived_features(align.pivot_long_to_wide(df, [635, 2782], [])).collect()
    assert len(wide) == 1
    assert wide[0].fio2_deviation == pytest.approx(-0.04, abs=1e-10)
    assert "volume_balance" not in wide[0].asDict()


def test_ratio_with_zero_denominator(spark):
    df = spark.createDataFrame([(350.0, 0.0), (350.0, 175.0)], "var_2098 double, var_2097 double")
    got = [r.o2_air_pressure_ratio for r in align.derived_features(df).collect()]
    assert got == [None, 2.0]


def test_active_only(spark):
    flags = [0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, None]
    df = spark.createDataFrame([(f,) for f in flags], "var_1889 double")
    assert align.active_only(df).count() == 7
    other = df.withColumnRenamed("var_1889", "x")
    assert align.active_only(other).count() == 10


def test_resample_and_fill_is_regular(spark):
    rows = [(START + dt.timedelta(minutes=3 * i), "a", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "timestamp timestamp, device_serial string, var_635 double")
    at = [r.timestamp for r in align.resample_and_fill(df).orderBy("timestamp").collect()]
    assert {b - a for a, b in zip(at, at[1:])} == {dt.timedelta(minutes=5)}


def test_feature_selection_and_padding(spark):
    cols = ["timestamp", "var_635", "var_584", "bitfield_x", "fio2_deviation"]
    assert align.feature_columns(cols, model_only=True) == ["var_635", "bitfield_x", "fio2_deviation"]
    with pytest.raises(ValueError):
        align.feature_columns(["timestamp"])
    df = spark.createDataFrame([(1.0,)], "var_635 double")
    assert align.pad_features(df, ["var_635", "var_1"]).first().asDict() == {"var_635": 1.0, "var_1": None}


def test_grid_must_divide_a_day():
    assert grid_seconds("5min") == 300
    with pytest.raises(ValueError):
        grid_seconds("7min")


def test_clean_long(spark):
    df = spark.createDataFrame(
        [("2025-12-01 00:00:00", "a", "635", "1.5", True), ("2025-12-01 00:00:00", "a", "x", "NaN", None),
         ("bad", "b", "635", "high", False)],
        "timestamp string, device_serial string, variable_id string, value string, bitfield_x boolean",
    )
    reg = spark.createDataFrame([("a",)], "device_serial string")
    rows = clean.clean_long(df, reg).orderBy(F.desc("value")).collect()
    assert [(r.variable_id, r.value, r.bitfield_x) for r in rows] == [(635, 1.5, 1), (None, None, None)]
    assert [r[0] for r in clean.unknown_devices(df, reg).collect()] == ["b"]

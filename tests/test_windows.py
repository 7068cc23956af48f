import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import windows

START = dt.datetime(2025, 12, 1)
FEATURES = ["var_1", "var_2"]


def frame(spark, spec, seed=3):
    """``spec``: device -> row times in minutes."""
    rng = np.random.default_rng(seed)
    rows = []
    for device, minutes in spec.items():
        for m in minutes:
            one = None if rng.random() < 0.2 else float(rng.normal(35, 0.01))
            rows.append((START + dt.timedelta(minutes=int(m)), device, one, float(rng.integers(0, 2))))
    return spark.createDataFrame(
        rows, "timestamp timestamp, device_serial string, var_1 double, var_2 double"
    )


def by_hand(df, window, step, sizing):
    out = {}
    for device, part in df.toPandas().sort_values("timestamp").groupby("device_serial"):
        at = part["timestamp"].to_numpy()
        if len(at) < 2:
            continue
        gap = np.median(np.diff(at).astype("timedelta64[s]").astype(float))
        base = step if sizing == "by_step" and gap <= step else gap
        win, hop = max(1, round(window / base)), max(1, round(step / base))
        x = part[FEATURES].to_numpy(dtype=float)
        for i, start in enumerate(range(0, len(at) - win + 1, hop)):
            chunk = x[start : start + win]
            if len(chunk) >= 2:
                delta = np.nan_to_num(chunk[-1] - chunk[0])
                with np.errstate(all="ignore"):
                    stats = [np.nanmean(chunk, 0), np.nanstd(chunk, 0), np.nanmin(chunk, 0),
                             np.nanmax(chunk, 0), delta]
                out[(device, i)] = (at[start], at[start + win - 1], win, np.concatenate(stats))
    return out


SPECS = {
    "regular": {"a": range(0, 500, 5), "b": range(0, 12, 5), "single": [0]},
    "dense": {"a": range(0, 200), "b": [*range(0, 40), *range(90, 130)]},
    "sparse": {"a": range(0, 3000, 20), "b": range(3, 900, 7), "c": range(0, 600, 12)},
}


@pytest.mark.filterwarnings("ignore")
@pytest.mark.parametrize("spec", SPECS)
@pytest.mark.parametrize("sizing", ["by_step", "duration"])
@pytest.mark.parametrize("slice,block", [("1h", 4), ("1d", 512)])
def test_windows_match_plain_python(spark, spec, sizing, slice, block):
    df = frame(spark, SPECS[spec])
    want = by_hand(df, 1800.0, 300.0, sizing)
    args = dict(sizing=sizing, slice=slice, block_windows=block)
    members = windows.sliding_windows(df, FEATURES, **args)
    by_aggregate = windows.window_stats(members, FEATURES)
    by_stream = windows.window_summaries(df, FEATURES, **args)
    names = windows.summary_columns(FEATURES)
    for table in (by_aggregate, by_stream):
        rows = table.toPandas()
        assert len(rows) == len(want)
        for r in rows.to_dict("records"):
            start, end, n, stats = want[(r["device_serial"], r["window_idx"])]
            assert (r["window_start"], r["window_end"], r["n_samples"]) == (start, end, n)
            np.testing.assert_allclose([r[c] for c in names], stats, atol=1e-9)


def test_known_count(spark):
    df = frame(spark, {"a": range(0, 500, 5)})
    meta = windows.window_metadata(windows.sliding_windows(df, FEATURES))
    assert meta.count() == 95
    assert {r.n_samples for r in meta.collect()} == {6}


def test_small_arrow_batches_do_not_change_summaries(spark):
    df = frame(spark, SPECS["dense"]).cache()
    whole = windows.window_summaries(df, FEATURES).orderBy("device_serial", "window_idx").collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        cut = windows.window_summaries(df, FEATURES).orderBy("device_serial", "window_idx").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert whole == cut


def test_tensor_order_and_padding(spark):
    df = frame(spark, {"a": range(0, 60, 5)})
    members = windows.sliding_windows(df, FEATURES)
    tensor = windows.window_tensor(members, FEATURES, length=8).orderBy("window_idx").first()
    assert len(tensor.tensor) == 8 and tensor.tensor[7] == [None, None]
    longest = windows.window_tensor(members, FEATURES, length="longest").first()
    assert len(longest.tensor) == longest.n_samples == 6
    first = df.orderBy("timestamp").select(*FEATURES).limit(6).collect()
    assert [tuple(r) for r in tensor.tensor[:6]] == [tuple(r) for r in first]


def test_span_limit_drops_bridging_windows(spark):
    df = frame(spark, {"a": [*range(0, 50, 5), *range(500, 550, 5)]})
    every = windows.window_metadata(windows.sliding_windows(df, FEATURES)).count()
    kept = windows.window_metadata(windows.sliding_windows(df, FEATURES, max_span="30min"))
    assert every == 15 and kept.count() == 10


def test_cadence(spark):
    df = frame(spark, {"a": [0, 5, 10, 30, 31], "b": [0, 10], "c": [0]})
    for slice in ("10min", "1d"):
        got = {r.device_serial: r.cadence_s for r in windows.cadence(df, slice).collect()}
        assert got == {"a": 300.0, "b": 600.0}


def test_unknown_sizing(spark):
    with pytest.raises(ValueError):
        windows.window_sizes(F.lit(60.0), "30min", "5min", "other")

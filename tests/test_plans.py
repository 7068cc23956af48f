"""Plan shape: pruning, pushdown and joins that survive large inputs."""

import datetime as dt

from pulsegrid.operators import align, clean, windows
from pulsegrid.operators.rank import fleet_percentile
from pulsegrid.session import materialize, scratch_path
from pulsegrid.sources import telemetry

START = dt.datetime(2025, 12, 1)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark):
    rows = [
        (START + dt.timedelta(hours=h), d, v, float(h), h % 2 == 0, "text")
        for h in range(48) for d in ("a", "b") for v in (635, 2782)
    ]
    df = spark.createDataFrame(
        rows,
        "timestamp timestamp, device_serial string, variable_id int, value double, bitfield_x boolean, note string",
    )
    path = scratch_path(spark, "table")
    telemetry.write_daily(df, path)
    return spark.read.parquet(path)


def test_scan_prunes_columns_and_pushes_predicates(spark):
    df = clean.scan_range(stored(spark), "2025-12-01", "2025-12-02", ["a"], [635], ordered=False)
    text = plan(df.select("timestamp", "value"))
    assert "note" not in text.split("ReadSchema")[1]
    pushed = text.split("PushedFilters")[1].split("ReadSchema")[0]
    for part in ("GreaterThanOrEqual(times", "IsNotNull(variable_id)", "IsNotNull(device_serial)"):
        assert part in pushed


def test_day_partitions_are_pruned(spark):
    df = stored(spark).where("day >= date'2025-12-02'")
    assert "day" in plan(df).split("PartitionFilters")[1].split("PushedFilters")[0]
    assert df.count() == 96


def test_binning_is_one_shuffle(spark):
    text = plan(align.bin_wide(stored(spark), "6h", [635, 2782], ["bitfield_x"]))
    assert text.count("Exchange hashpartitioning") == 1
    assert "note" not in text.split("ReadSchema")[1]


def test_no_cartesian_or_nested_loop_joins(spark):
    long = stored(spark)
    wide = materialize(align.resample_then_pivot(long, "6h", "6h", [635, 2782], slice_bins=4))
    stats = windows.window_summaries(wide, ["var_635", "var_2782"], "12h", "6h")
    scores = stats.selectExpr(
        "device_serial", "window_end as timestamp", "var_635__mean as anomaly_score"
    )
    for df in (align.resample_then_pivot(long, "6h", "6h", [635, 2782]), stats, fleet_percentile(scores)):
        text = plan(df)
        assert "NestedLoop" not in text and "Cartesian" not in text
    assert fleet_percentile(scores).count() == stats.count() > 0

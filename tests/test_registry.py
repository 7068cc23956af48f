from pyspark.sql import functions as F

from pulsegrid import dims, fixed
from pulsegrid.functions.text import human_name, normalize_serial, top_features_text


def test_fleet_has_thirty_unique_fifteen_digit_serials(spark):
    rows = dims.registry(spark).collect()
    serials = {r.device_serial for r in rows}
    assert len(rows) == len(serials) == 30
    assert all(len(s) == 15 and s.isdigit() for s in serials)


def test_serial_normalisation(spark):
    df = spark.createDataFrame([("0408810hul08204503",), ("08209508",)], "s string")
    got = [r[0] for r in df.select(normalize_serial(F.col("s"))).collect()]
    assert got == ["000000008204503", "000000008209508"]


def test_events(spark):
    failures = dims.failures(spark).collect()
    assert {f.cmms_reg for f in failures} == {18823, 18817, 18839, 18833}
    assert {f.device_serial for f in failures if f.cmms_reg == 18839} == {"000000008204570"}
    services = dims.services(spark).collect()
    assert len(services) == 28
    assert all((s.event_date.year, s.event_date.month) == (2025, 12) for s in services)


def test_taxonomy_sizes():
    assert [len(fixed.TIER_IDS[t]) for t in (1, 2, 3)] == [14, 12, 3]
    assert len(fixed.STATUS_BITS) == len(fixed.STATUS_FEATURES) == 17
    assert len(fixed.MODEL_FEATURES) == 46


def test_names(spark):
    df = spark.createDataFrame(
        [("var_635",), ("fio2_deviation",), ("bitfield_safety_valve_ok",), ("var_99",)], "f string"
    )
    got = [r[0] for r in df.select(human_name(F.col("f"))).collect()]
    assert got == ["fio2_measured", "FiO2 deviation", "safety valve ok", "var_99"]
    assert top_features_text(["var_635", "fio2_deviation", "x", "y"]) == (
        "fio2_measured (var_635), FiO2 deviation (measured - setting), x"
    )

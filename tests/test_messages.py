import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import messages as ms
from pulsegrid.plans.ingest import ingest
from pulsegrid.session import scratch_path
from pulsegrid.sources import messages as src


def obx(no, var, value, unit="", time="20260101120000"):
    return f"OBX|{no}|NM|{var}^name^L|1|{value}|{unit}|||||F|||{time}"


def message(*segments, model="Elisa 800", control="M1"):
    head = [f"MSH|^~\\&|D|S|R|F|20260101120000||ORU^R01|{control}|P|2.3", f"OBR|1|R|F|999^{model}^L"]
    return "\r".join([*head, *segments])


def frame(spark, texts, src_name="gw"):
    rows = [(src_name, i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "src string, pos long, message string")


def parsed(spark, texts, **kw):
    return ms.assign_serial(ms.with_segments(frame(spark, texts)), **kw)


def test_status_words_decode_all_flags(spark):
    words = {"801": 126, "802": 18, "803": 127, "804": 3}
    text = message(*[obx(i, v, w) for i, (v, w) in enumerate(words.items())], obx(9, "1913", "42"))
    rows = ingest(frame(spark, [text])).toPandas()
    flags = [c for c in rows.columns if c.startswith("bitfield_")]
    assert len(flags) == 17
    assert rows[flags].any().all()
    assert not rows[rows.variable_id == "1913"][flags].any().any()
    shown = ms.observations(parsed(spark, [text])).select(
        "variable_id", ms.status_json(ms.status_map(F.col("variable_id"), F.col("value"))).alias("j")
    )
    by_id = {r.variable_id: r.j for r in shown.collect()}
    assert json.loads(by_id["804"]) == {"Expiratory Flow Sensor OK": True, "Inspiratory Flow Sensor OK": True}
    assert by_id["1913"] == ""


def test_unreadable_status_word(spark):
    rows = ms.observations(parsed(spark, [message(obx(1, "801", "n/a"))]))
    out = rows.select(ms.status_json(ms.status_map(F.col("variable_id"), F.col("value")))).first()
    assert out[0] == ""


def test_unit_and_time_fields_where_the_parser_reads_them(spark):
    shifted = "OBX|1|NM|635^x^L|1|40||%|||||F|||20260101120000"
    row = ms.enrich(ms.observations(parsed(spark, [message(shifted)]))).first()
    assert (row.unit, row.timestamp) == ("%", "")
    row = ms.enrich(ms.observations(parsed(spark, [message(shifted)]), unit_field=7, time_field=15)).first()
    assert (row.unit, row.timestamp) == ("%", "20260101120000")
    row = ms.enrich(ms.observations(parsed(spark, [message(obx(1, "2097", "350", "42"))]))).first()
    assert (row.unit, row.unit_short, row.label) == ("42", "kPa", "Air Supply Pressure")


def test_value_texts(spark):
    text = message(obx(1, "584", "vv"), obx(2, "584", "??"), obx(3, "2046", "1"), obx(4, "2046", "7"),
                   obx(5, "777", "x"), obx(6, "635", "1"))
    rows = ms.enrich(ms.observations(parsed(spark, [text]))).orderBy("obx").collect()
    assert [r.value_description for r in rows] == ["PC-APRV", "??", "Alarm ON", "7", "x", "1"]
    assert rows[4].label == "777" and rows[4].unit == ""


def test_gate_rejects_other_models_but_their_serial_carries(spark):
    texts = [
        message(obx(1, "635", "1")),
        message(obx(1, "1913", "A1^x")),
        message(obx(1, "1913", "B2"), model="Elisa 500"),
        message(obx(1, "635", "2"), obx(2, "1913", " ")),
        message(obx(1, "1913", "C3"), obx(2, "1913", "D4")),
    ]
    for chunk in (2, 4096):
        rows = parsed(spark, texts, chunk=chunk).orderBy("pos").collect()
        assert [r.device_serial for r in rows] == ["unknown", "A1", "B2", "B2", "D4"]
    kept = {r.pos for r in ms.observations(parsed(spark, texts)).collect()}
    assert kept == {0, 1, 3, 4}


def test_control_id(spark):
    df = frame(spark, [message(control="77"), "MSH|a|b", "PID|1"])
    got = [r[0] for r in df.orderBy("pos").select(ms.control_id(F.col("message"))).collect()]
    assert got == ["77", "", ""]


@pytest.mark.parametrize("text,good", [("20260101120000", True), ("20260101120000.123", True), ("2026", False), ("20261399120000", False), ("", False)])
def test_time(spark, text, good):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(ms.message_time(F.col("t")).alias("t"), ms.epoch_ns(F.col("t")).alias("ns")).first()
    assert (got.t is not None) is good
    if good:
        assert got.ns == 1767268800 * 10**9


def test_quarantine(spark):
    df = parsed(spark, [message(obx(1, "635", "1", time="20261399120000"), "OBX|2|NM", obx(3, "635", "1"))])
    assert ms.unreadable(df).count() == 2


def test_line_protocol(spark):
    text = message(obx(1, "635", 'say "hi"', "19"), obx(2, "1913", "S 1,2=3"))
    line = ms.line_protocol(ingest(frame(spark, [text])).where("variable_id = '635'")).first()[0]
    head, rest = line.split(" ", 1)
    assert head == "pdm_medical_device,variable_id=635,device_serial=S_123"
    assert 'value="say \\"hi\\""' in rest and "bitfield_gas_supplies_ok=f" in rest
    assert rest.endswith(f" {1767268800 * 10**9}")


def write(spark, text):
    path = scratch_path(spark, "text")
    rows = spark.createDataFrame([(text,)], "value string").coalesce(1)
    rows.write.option("lineSep", "\x00").text(path)
    return path


def test_text_captures_with_any_line_end(spark):
    texts = [message(obx(1, "635", str(i)), control=str(i)) for i in range(5)]
    for newline in ("\n", "\r\n", "\r"):
        capture = newline.join(t.replace("\r", newline) for t in texts)
        got = src.read_message_files(spark, write(spark, "  stray line\n" + capture + "\n"))
        ids = [r[0] for r in got.orderBy("block", "seq", "part").select(ms.control_id(F.col("message"))).collect()]
        assert [i for i in ids if i not in ("", "\x00")] == ["0", "1", "2", "3", "4"]


def test_large_capture_is_read_in_splits(spark):
    texts = [message(obx(1, "635", str(i)), control=str(i)).replace("\r", "\n") for i in range(2000)]
    path = write(spark, "\n".join(texts))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = src.read_message_files(spark, path)
        assert got.rdd.getNumPartitions() > 3
        ids = [r[0] for r in got.orderBy("block", "seq").select(ms.control_id(F.col("message"))).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert ids == [str(i) for i in range(2000)]


def test_carriage_return_capture_is_read_in_splits(spark):
    texts = [message(obx(1, "635", str(i)), control=str(i)) for i in range(2000)]
    path = write(spark, "\r".join(texts))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = src.read_message_files(spark, path, line_end="\r")
        spread = got.groupBy("block").count().collect()
        ids = [r[0] for r in got.orderBy("block", "seq", "part").select(ms.control_id(F.col("message"))).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [i for i in ids if i not in ("", "\x00")] == [str(i) for i in range(2000)]
    assert len(spread) > 3 and max(r["count"] for r in spread) < 1000


def test_frames_drop_the_unfinished_one(spark):
    a, b = message(control="1"), message(control="2")
    capture = f"noise\x0b{a}\x1c\r\x0b{b}\x1c\r\x0bMSH|cut off"
    got = src.read_frames(spark, write(spark, capture))
    assert [r.message for r in got.orderBy("block", "seq").collect()] == [a, b]


def capture(spark, folder_texts):
    """Plain text captures, one file a source, read in small splits."""
    path = scratch_path(spark, "captures")
    for i, texts in enumerate(folder_texts):
        rows = spark.createDataFrame([("\n".join(t.replace("\r", "\n") for t in texts),)], "value string")
        rows.coalesce(1).write.mode("append").option("lineSep", "\x00").text(f"{path}/f{i}")
    return path + "/*"


def expected_serials(texts, serials):
    out, last = [], "unknown"
    for s in serials:
        last = s or last
        out.append(last)
    return out


def shuffled_columns(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_serials_are_filled_where_messages_are_read(spark):
    serials = [[None, None] + [f"S{i // 300}" if i % 300 == 7 else None for i in range(1500)], [None] * 3, ["A"] + [None] * 900]
    texts = [
        [message(obx(1, "635", str(i)), *([obx(2, "1913", s)] if s else []), control=str(i)) for i, s in enumerate(own)]
        for own in serials
    ]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        read = src.read_message_files(spark, capture(spark, texts))
        assert read.rdd.getNumPartitions() > 8
        filled = ms.assign_serial_in_place(read)
        got = filled.withColumn("id", ms.control_id(F.col("message")).cast("int")).orderBy("src", "id").collect()
        rows = ingest(read, order=["seq", "part"], slices=["block"])
        assert shuffled_columns(filled) == [] and shuffled_columns(rows) == []
        assert rows.where("variable_id = '635'").count() == sum(map(len, texts))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    by_file = {}
    for r in got:
        by_file.setdefault(r.src, []).append(r.device_serial)
    assert [by_file[k] for k in sorted(by_file)] == [expected_serials(t, s) for t, s in zip(texts, serials)]


def test_overlapping_slices_null_sources_ties_and_empty_tables(spark):
    own = [None, "A", None, None, "B", None, "C", "D", None]
    pos = [0, 1, 2, 3, 4, 5, 6, 6, 7]
    rows = [(s, p, p // 3, message(obx(1, "635", "1"), *([obx(2, "1913", o)] if o else []))) for s in (None, "gw") for p, o in zip(pos, own)]
    df = spark.createDataFrame(rows, "src string, pos long, block long, message string").repartition(1)
    got = ms.assign_serial_in_place(df, ["pos"], min_tasks=1).orderBy("src", "pos", "device_serial").collect()
    want = ["unknown", "A", "A", "A", "B", "B", "C", "D", "D"]
    assert [r.device_serial for r in got] == want * 2
    mixed = df.withColumn("block", F.col("pos") % 2).where("src is not null and pos <> 6")
    got = ms.assign_serial_in_place(mixed, ["pos"], min_tasks=1).orderBy("pos").collect()
    assert [r.device_serial for r in got] == ["unknown", "A", "A", "A", "B", "B", "B"]
    assert ms.assign_serial_in_place(df.where("pos < 0"), ["pos"], min_tasks=0).count() == 0


def test_serials_are_carried_over_chunks_that_are_not_sorted(spark):
    from pulsegrid.operators.ordered import carry_in_place

    rng, rows = np.random.default_rng(2), []
    for start in range(0, 600, 50):  # chunks of 50 rows a file piece, in no order inside
        part = [(k % 2, i, "x" * 50, f"S{i}" if i % 37 == 5 else None) for i in range(start, start + 25) for k in range(2)]
        rows += [part[j] for j in rng.permutation(len(part))]
    df = spark.createDataFrame(rows, "src long, pos long, message string, own string").repartition(1)
    df = spark.read.schema(df.schema).parquet(written(spark, df)).withColumn("block", F.lit(0))
    filled = carry_in_place(df, ["src"], ["pos"], ["block"], "own", "last", chunk=50)
    assert "Sort" not in filled._jdf.queryExecution().executedPlan().toString()  # whole messages are not sorted
    want, last = {}, {}
    for src_, pos, _, own in sorted(rows, key=lambda r: r[:2]):
        last[src_] = own or last.get(src_)
        want[src_, pos] = last[src_]
    got = filled.collect()
    assert len(got) == len(rows) and {(r.src, r.pos): r["last"] for r in got} == want
    assert carry_in_place(df, ["src"], ["pos"], ["block"], "own", "last", chunk=30) is None
    plain = carry_in_place(df, ["src"], ["pos"], ["block"], "own", "own", chunk=700)
    assert {(r.src, r.pos): r["own"] for r in plain.collect()} == want


def written(spark, df):
    path = scratch_path(spark, "captured")
    df.write.parquet(path)
    return path

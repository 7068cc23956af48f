import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from pulsegrid.operators.alerts import sustained_alerts
from pulsegrid.operators.rank import fleet_percentile
from pulsegrid.session import scratch_path
from pulsegrid.streaming import jobs

START = dt.datetime(2025, 12, 1)
STEP = dt.timedelta(minutes=5)


def scores(spark, steps):
    rng = np.random.default_rng(4)
    base = rng.normal(0, 1, (30, 60))
    base[3, 15:30] += 50
    base[5, 18:22] += 60
    rows = [
        (f"d{d}", START + (t - 5) * STEP, START + t * STEP, START + t * STEP, float(base[d, t]))
        for d in range(30) for t in steps
    ]
    return spark.createDataFrame(
        rows, "device_serial string, window_start timestamp, window_end timestamp, timestamp timestamp, anomaly_score double"
    )


def test_runs_that_cross_micro_batches_match_the_batch_result(spark):
    registry = spark.createDataFrame([("d3", 3)], "device_serial string, cmms_reg int")
    source, tails = scratch_path(spark, "in"), scratch_path(spark, "tails")
    out, checkpoint = scratch_path(spark, "out"), scratch_path(spark, "cp")
    schema = scores(spark, [0]).schema
    for part in (range(0, 20), range(20, 40), range(40, 60)):
        scores(spark, part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.alert_stream(stream, registry, tails, out, checkpoint).awaitTermination()
    seen = spark.read.parquet(out).where("alert_level <> 'normal'").toPandas()
    longest = seen.sort_values("n_anomalous_windows").drop_duplicates(["device_serial", "alert_start"], keep="last")
    whole = sustained_alerts(fleet_percentile(scores(spark, range(60))), registry)
    want = {(r.device_serial, r.alert_start, r.alert_end, r.n_anomalous_windows)
            for r in whole.where("alert_level <> 'normal'").collect()}
    got = {(r.device_serial, r.alert_start.to_pydatetime(), r.alert_end.to_pydatetime(), r.n_anomalous_windows)
           for r in longest.itertuples()}
    assert ("d3", START + 10 * STEP, START + 29 * STEP, 15) in got
    assert got == want


def test_timestamps_delivered_in_two_halves_are_ranked_whole(spark):
    registry = spark.createDataFrame([("d3", 3)], "device_serial string, cmms_reg int")
    source, state, out, checkpoint = (scratch_path(spark, n) for n in ("in", "state", "out", "cp"))
    whole = scores(spark, range(60)).where("substring(device_serial, 2) < 20").cache()
    step = "cast((unix_seconds(timestamp) - 1764547200) / 300 as int)"
    for k in range(3):
        for half in ("<", ">="):
            some = whole.where(f"int({step} / 20) = {k} and cast(substring(device_serial, 2) as int) % 10 {half} 5")
            some.coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.alert_stream(stream, registry, state, out, checkpoint, lateness="101min").awaitTermination()
    early = jobs.latest_alerts(spark.read.parquet(out)).where("alert_level <> 'normal'").collect()
    jobs.close_alerts(whole.schema, spark, registry, state, out)
    assert all(len(jobs._versions(spark, f"{state}/{n}")) == 2 for n in ("open", "held", "clock"))
    got = {tuple(r) for r in jobs.latest_alerts(spark.read.parquet(out)).collect()}
    want = {tuple(r) for r in sustained_alerts(fleet_percentile(whole), registry).collect()}
    assert got == want and len({r[2] for r in want}) > 1
    assert {tuple(r) for r in early} <= want


def test_serial_state_survives_micro_batches(spark):
    source = scratch_path(spark, "msgs")
    text = lambda serial: "MSH|x" + (f"\rOBX|1|NM|1913^s^L|1|{serial}|" if serial else "")
    state, checkpoint, out = (scratch_path(spark, n) for n in ("state", "cp", "out"))
    for batch in ([("a", 1, "S1"), ("b", 1, None)], [("a", 3, None), ("a", 2, "S2"), ("b", 2, "T1")], [("a", 4, None), ("b", 3, None)], [("b", 4, None)], [("a", 5, None)]):
        rows = [(s, p, text(v)) for s, p, v in batch]
        df = spark.createDataFrame(rows, "src string, pos long, message string")
        df.write.mode("append").parquet(source)
        stream = spark.readStream.schema(df.schema).parquet(source)
        jobs.carry_serial_stream(stream, state, out, checkpoint, chunk=2).awaitTermination()
    got = {(r.src, r.pos): r.device_serial for r in spark.read.parquet(out).collect()}
    assert got == {("a", 1): "S1", ("b", 1): "unknown", ("a", 2): "S2", ("a", 3): "S2", ("b", 2): "T1", ("a", 4): "S2", ("b", 3): "T1",
                   ("b", 4): "T1", ("a", 5): "S2"}


def test_resent_messages_are_dropped_across_batches(spark):
    source, checkpoint, out = scratch_path(spark, "in"), scratch_path(spark, "cp"), scratch_path(spark, "out")
    text = lambda n: f"MSH|a|b|c|d|e|f|g|h|{n}|P"
    for ids in ([1, 2], [2, 3]):
        df = spark.createDataFrame([("gw", START, text(n)) for n in ids], "src string, timestamp timestamp, message string")
        df.write.mode("append").parquet(source)
        once = jobs.deduplicate_stream(spark.readStream.schema(df.schema).parquet(source), "1h")
        once.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    assert sorted(r.control_id for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_queries_deliver_parts_by_many_tasks_and_in_order(spark, monkeypatch):
    from pulsegrid.workloads import stream_queries as sq

    source = scratch_path(spark, "events")
    spark.range(400).withColumn("k", F.col("id") % 2).repartition(4).write.parquet(source)
    files, seen = [], []

    def start(stream):
        def each(batch, number):
            files.append(len({r[0] for r in batch.select(F.input_file_name()).collect()}))
            seen.append(sorted(r["id"] for r in batch.collect()))

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    checkpoint, events = scratch_path(spark, "cp"), spark.read.schema("id long, k long").parquet(source)
    events = events.repartition(4)
    sq._delivered([events.where(f"id div 200 = {k}") for k in range(2)], "parts", start)
    assert seen == [list(range(200)), list(range(200, 400))] and min(files) > 1

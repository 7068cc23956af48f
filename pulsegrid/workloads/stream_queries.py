"""Streaming queries: each drains a file source once and returns what was written."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.session import scratch_path
from pulsegrid.streaming import jobs
from pulsegrid.workloads import adapter as ad
from pulsegrid.workloads.alert_queries import CRITICAL, SUSTAINED, THRESHOLD
from pulsegrid.workloads.message_queries import _ROWS, _TIME
from pulsegrid.workloads.registry import query
from pulsegrid.workloads.views_sql import sql


def _stream(df, label, **options):
    """``df`` written to files once and read as a stream."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    reader = df.sparkSession.readStream.schema(df.schema).options(**options)
    return reader.parquet(path)


def _delivered(parts, label, start):
    """Parts written one after the other, each by as many tasks as it has; ``start`` drains what has come
    as one micro-batch."""
    path = scratch_path(parts[0].sparkSession, label)
    for part in parts:
        part.write.mode("append").parquet(path)
        start(part.sparkSession.readStream.schema(part.schema).parquet(path)).awaitTermination()


_LATE = "(SELECT max(timestamp) FROM telemetry) - INTERVAL 1 DAY"
_SIX = "make_timestamp((epoch_us(timestamp) // 21600000000) * 21600000000)"


@query(
    "stream_hl7",
    sql(f"SELECT {_ROWS}, {_TIME} AS timestamp, CAST({_TIME} AS DATE) AS day FROM enriched"),
    dates=("day",),
)
def stream_hl7(spark, sf):
    """Messages to stored telemetry rows in three micro-batches, each source's messages in order."""
    sent = ad.messages(spark, sf).select("src", "pos", "message")
    out, serials, checkpoint = (scratch_path(spark, n) for n in ("stream-rows", "last-serials", "ingest-checkpoint"))
    third = (sent.agg(F.max("pos")).first()[0] or 0) // 3 + 1
    parts = [sent.where(F.floor(F.col("pos") / third) == k) for k in range(3)]
    _delivered(parts, "stream-messages", lambda stream: jobs.ingest_stream(stream, serials, out, checkpoint))
    return spark.read.parquet(out).drop("batch_id")


@query(
    "stream_resample",
    sql(f"""SELECT device_serial, variable_id, {_SIX} AS bin, round(avg(value) + 1e-10, 6) + 0.0 AS value, count(*) AS n_rows
        FROM telemetry GROUP BY 1, 2, 3 HAVING bin + INTERVAL 6 HOUR <= {_LATE}"""),
)
def stream_resample(spark, sf):
    stream = _stream(ad.telemetry(spark, sf, status=False), "stream-telemetry")
    return jobs.run_available(jobs.resample_stream(stream, ad.FREQ, "1d"), "bins")


@query(
    "stream_windows",
    sql(
        f"""SELECT device_serial, variable_id, window_start, window_start + INTERVAL 36 HOUR AS window_end,
        round(avg(value) + 1e-10, 6) + 0.0 AS mean, round(stddev_pop(value) + 1e-10, 6) + 0.0 AS std, round(min(value) + 1e-10, 6) + 0.0 AS min,
        round(max(value) + 1e-10, 6) + 0.0 AS max, round(arg_max(value, timestamp) - arg_min(value, timestamp) + 1e-10, 6) + 0.0 AS delta,
        count(*) AS n_samples
        FROM (SELECT *, {_SIX} - to_hours(6 * unnest(generate_series(0, 5))) AS window_start FROM telemetry)
        GROUP BY 1, 2, 3 HAVING window_start + INTERVAL 36 HOUR <= {_LATE}"""
    ),
)
def stream_windows(spark, sf):
    stream = _stream(ad.telemetry(spark, sf, status=False), "stream-telemetry")
    return jobs.run_available(jobs.window_stream(stream, ad.WINDOW, ad.STEP, "1d"), "windows")


@query("stream_serial_carry", sql("SELECT src, pos, device_serial FROM parsed"))
def stream_serial_carry(spark, sf):
    stream = _stream(ad.messages(spark, sf), "stream-messages")
    out = scratch_path(spark, "stream-serials")
    jobs.carry_serial_stream(
        stream, scratch_path(spark, "last-serials"), out, scratch_path(spark, "serials-checkpoint")
    ).awaitTermination()
    return spark.read.parquet(out).select("src", "pos", "device_serial")


@query("stream_dedup", sql("SELECT src, CAST(pos AS VARCHAR) AS control_id, message FROM messages"))
def stream_dedup(spark, sf):
    sent = ad.messages(spark, sf)
    stream = _stream(sent.unionByName(sent), "stream-resent")
    once = jobs.deduplicate_stream(stream, "1d").select("src", "control_id", "message")
    return jobs.run_available(once, "once")


@query("stream_alerts", sql("SELECT * FROM alert_rows"))
def stream_alerts(spark, sf):
    """Alerts of a stream of scores, each third of the time delivered in two halves of the fleet: six
    micro-batches, with waiting rows and run state carried between them."""
    scores = ad.scores(spark, sf)
    first, last = (r.timestamp() for r in scores.agg(F.min("timestamp"), F.max("timestamp")).first())
    third = int((last - first) / 3) + 1
    out, state = (scratch_path(spark, n) for n in ("stream-alerts", "alert-state"))
    part = F.floor((F.unix_seconds("timestamp") - int(first)) / third)
    half = F.pmod(F.xxhash64("device_serial"), F.lit(2))
    rules = (THRESHOLD, SUSTAINED, CRITICAL, ad.SLICE)
    registry = ad.registry(spark, sf)
    checkpoint = scratch_path(spark, "alerts-checkpoint")
    parts = [scores.where((part == k) & (half == h)) for k in range(3) for h in range(2)]
    _delivered(parts, "stream-scores", lambda stream: jobs.alert_stream(
        stream, registry, state, out, checkpoint, *rules, lateness=f"{third + 1}s"
    ))
    jobs.close_alerts(scores.schema, spark, registry, state, out, *rules)
    return jobs.latest_alerts(spark.read.parquet(out))

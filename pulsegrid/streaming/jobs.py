"""Structured Streaming forms of ingestion, alignment, windows and alerting.

Every function takes a streaming DataFrame and returns one, or starts from a micro-batch; sinks
and triggers are the caller's choice (:func:`run_available` drains a source into Parquet)."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from pulsegrid.functions.grid import seconds
from pulsegrid.operators import messages as ms
from pulsegrid.operators.alerts import sustained_alerts
from pulsegrid.operators.ordered import carry_last
from pulsegrid.operators.rank import SLICE, fleet_percentile
from pulsegrid.session import materialize, scratch_path


def run_available(stream: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Process what the source holds now, append to Parquet, return the written table."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", scratch_path(spark, f"{label}-checkpoint"))
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def observation_stream(messages: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Messages with their serial to enriched observations; stateless, so append-only."""
    return ms.enrich(ms.observations(ms.with_segments(messages)), catalog)


def resample_stream(long: DataFrame, freq: str, lateness: str) -> DataFrame:
    """Mean per (device, variable, bin); a bin is final once the watermark passes its end."""
    return (
        long.withWatermark("timestamp", f"{seconds(lateness)} seconds")
        .groupBy(
            "device_serial",
            "variable_id",
            F.window("timestamp", f"{seconds(freq)} seconds").alias("w"),
        )
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_rows"))
        .select("device_serial", "variable_id", F.col("w.start").alias("bin"), "value", "n_rows")
    )


def window_stream(
    long: DataFrame, window: str, step: str, lateness: str
) -> DataFrame:
    """Sliding *time* windows per (device, variable) with the five summary statistics.

    Unlike the batch windows these are cut by clock time, not by row position."""
    return (
        long.withWatermark("timestamp", f"{seconds(lateness)} seconds")
        .groupBy(
            "device_serial",
            "variable_id",
            F.window("timestamp", f"{seconds(window)} seconds", f"{seconds(step)} seconds").alias("w"),
        )
        .agg(
            F.avg("value").alias("mean"),
            F.stddev_pop("value").alias("std"),
            F.min("value").alias("min"),
            F.max("value").alias("max"),
            (F.max_by("value", "timestamp") - F.min_by("value", "timestamp")).alias("delta"),
            F.count(F.lit(1)).alias("n_samples"),
        )
        .select(
            "device_serial",
            "variable_id",
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "mean", "std", "min", "max", F.coalesce("delta", F.lit(0.0)).alias("delta"), "n_samples",
        )
    )


def carry_serial_stream(
    messages: DataFrame, serials_path: str, out_path: str, checkpoint: str, chunk: int = 4096,
    finish: Callable[[DataFrame], DataFrame] | None = None,
):
    """Serial carry-forward per source across micro-batches; ``finish`` makes of the messages with
    their serials what is written.

    Inside a batch the sliced batch operator applies, so a busy source is spread over tasks; the
    last serial of each source is kept in a versioned table (one row per source, one folder per
    batch, the two newest kept). Batch folders are overwritten on a retry, so each counts once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        batch = batch.persist()
        own = batch.withColumns(
            {
                "_own": ms.message_serial(F.col("message")),
                "_part": F.floor(F.col("pos") / F.lit(chunk)).cast("bigint"),
            }
        )
        rows = carry_last(own, ["src"], ["pos"], "_part", "_own", "device_serial")
        at = F.when(F.col("_own").isNotNull(), F.col("pos"))
        newest = own.groupBy("src").agg(F.max_by("_own", at).alias("last"))
        before = _read_latest(batch.sparkSession, serials_path, batch_id, "src string, last string")
        if before is not None:
            earlier = before.withColumnRenamed("last", "_earlier")
            rows = rows.join(earlier, "src", "left").withColumn(
                "device_serial", F.coalesce("device_serial", "_earlier")
            )
            newest = newest.join(earlier, "src", "full").select(
                "src", F.coalesce("last", "_earlier").alias("last")
            )
        named = rows.select(
            *batch.columns, F.coalesce("device_serial", F.lit("unknown")).alias("device_serial")
        )
        done = named if finish is None else finish(named)
        done.write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        _write_version(newest, serials_path, batch_id)
        batch.unpersist()

    return (
        messages.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def ingest_stream(
    messages: DataFrame, serials_path: str, out_path: str, checkpoint: str,
    catalog: DataFrame | None = None, chunk: int = 4096,
):
    """Messages (src, pos, message) to rows of the raw telemetry table, batch by batch: the serial is
    carried forward per source, observations are enriched, status bits and times decoded. Each
    batch's folder is overwritten on a retry, so rows are stored once."""

    def rows(named: DataFrame) -> DataFrame:
        slim = named.select("src", "pos", "device_serial", "message")
        return ms.telemetry_rows(ms.enrich(ms.observations(ms.with_segments(slim)), catalog))

    return carry_serial_stream(messages, serials_path, out_path, checkpoint, chunk, rows)


def deduplicate_stream(messages: DataFrame, lateness: str) -> DataFrame:
    """Drop re-sent messages: same source and control id within the watermark."""
    return (
        messages.withColumn("control_id", ms.control_id(F.col("message")))
        .withWatermark("timestamp", f"{seconds(lateness)} seconds")
        .dropDuplicatesWithinWatermark(["src", "control_id"])
    )


def alert_stream(
    scores: DataFrame, registry: DataFrame, state: str, alerts_path: str, checkpoint: str,
    threshold: float = 0.95, sustained: int = 3, critical: float = 0.99, slice: str = SLICE,
    lateness: str = "0s",
):
    """Alerts per micro-batch of scored windows, ranked over whole timestamps.

    Rows wait until a row ``lateness`` newer than them has come, so that a timestamp whose devices are
    delivered in several batches is ranked once and against its whole fleet; rows that come later than
    that are late and left out. Ranked rows of runs still above the threshold are kept as well, so a
    run that crosses batches is seen whole and reported again with its longer extent (see
    :func:`latest_alerts`). What waits at the end of the input is ranked by :func:`close_alerts`.

    Waiting rows, open runs and the time passed are versioned tables below ``state``, one folder per
    batch; a retried batch reads the version before its own, and the two newest are kept."""

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        held = batch.persist()
        try:
            _alert_step(held, batch_id, registry, state, alerts_path, threshold, sustained, critical, slice, seconds(lateness))
        finally:
            held.unpersist()

    return (
        scores.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def close_alerts(
    scores_schema: StructType, spark: SparkSession, registry: DataFrame, state: str, alerts_path: str,
    threshold: float = 0.95, sustained: int = 3, critical: float = 0.99, slice: str = SLICE,
) -> None:
    """Rank what still waits below ``state`` once no more rows are to come."""
    last = _versions(spark, f"{state}/clock")
    if last:
        nothing = spark.createDataFrame([], scores_schema)
        _alert_step(nothing, last[-1] + 1, registry, state, alerts_path, threshold, sustained, critical, slice, None)


def _alert_step(
    batch: DataFrame, batch_id: int, registry: DataFrame, state: str, alerts_path: str,
    threshold: float, sustained: int, critical: float, slice: str, wait: int | None,
) -> None:
    """One batch of :func:`alert_stream`; ``wait`` seconds, or None to let nothing wait on."""
    spark = batch.sparkSession
    clock = _read_latest(spark, f"{state}/clock", batch_id, "passed timestamp")
    passed = None if clock is None else clock.first()["passed"]
    newest = None if wait is None else batch.agg(F.max("timestamp")).first()[0]
    limit = passed
    if newest is not None:
        limit = max(filter(None, [passed, newest - dt.timedelta(seconds=wait)]))
    rows = batch if passed is None else batch.where(F.col("timestamp") > F.lit(passed))
    held = _read_latest(spark, f"{state}/held", batch_id, batch.schema)
    rows = rows if held is None else rows.unionByName(held)
    complete = F.lit(True) if wait is None else F.coalesce(F.col("timestamp") <= F.lit(limit), F.lit(False))
    ready = materialize(rows.where(complete), "ready-scores")

    ranked = fleet_percentile(ready)
    earlier = _read_latest(spark, f"{state}/open", batch_id, ranked.schema)
    window = ranked if earlier is None else earlier.unionByName(ranked.select(*earlier.columns))
    fresh = window.join(ready.select("device_serial").distinct(), "device_serial", "left_semi")
    sustained_alerts(fresh, registry, threshold, sustained, critical, slice=slice).write.mode(
        "overwrite"
    ).parquet(f"{alerts_path}/batch_id={batch_id}")
    _write_version(_open_tail(window, threshold), f"{state}/open", batch_id)
    _write_version(rows.where(~complete), f"{state}/held", batch_id)
    _write_version(spark.createDataFrame([(limit,)], "passed timestamp"), f"{state}/clock", batch_id)


def latest_alerts(alerts: DataFrame) -> DataFrame:
    """Reports of all batches (batch_id) as one batch would give them: each run with its longest
    extent, and one normal row for a device without a run."""
    columns = [c for c in alerts.columns if c != "batch_id"]
    actual = F.col("alert_level") != "normal"
    runs = (
        alerts.where(actual).groupBy("device_serial", "alert_start")
        .agg(F.max_by(F.struct(*columns), "batch_id").alias("row")).select("row.*")
    )
    quiet = alerts.where(~actual).join(runs.select("device_serial").distinct(), "device_serial", "left_anti")
    peaks = {"anomaly_score", "fleet_percentile"}
    quiet = quiet.groupBy("device_serial").agg(
        *[(F.max(c) if c in peaks else F.first(c)).alias(c) for c in columns if c != "device_serial"]
    )
    return runs.select(*columns).unionByName(quiet.select(*columns))


def _open_tail(window: DataFrame, threshold: float) -> DataFrame:
    """Rows after each device's last row below the threshold: the run that may go on."""
    below = F.max(
        F.when(~F.coalesce(F.col("fleet_percentile") >= threshold, F.lit(False)), F.col("window_end"))
    )
    last_quiet = window.groupBy("device_serial").agg(below.alias("_quiet"))
    return (
        window.join(last_quiet, "device_serial")
        .where("_quiet is null or window_end > _quiet")
        .drop("_quiet")
    )


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Batches that have written a whole version, ascending."""
    root, system = _files(spark, path)
    if not system.exists(root):
        return []
    names = [s.getPath().getName() for s in system.listStatus(root)]
    ids = sorted(int(n.split("-")[1]) for n in names if n.startswith("batch-"))
    return [i for i in ids if system.exists(_files(spark, f"{path}/batch-{i}/_SUCCESS")[0])]


def _write_version(df: DataFrame, path: str, batch_id: int) -> None:
    """State after a batch. The version before it stays for a retry; older ones go."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
    for old in [i for i in _versions(spark, path) if i < batch_id][:-1]:
        place, system = _files(spark, f"{path}/batch-{old}")
        system.delete(place, True)


def _read_latest(
    spark: SparkSession, path: str, batch_id: int, schema: StructType | str
) -> DataFrame | None:
    """The state written by the previous batch that had rows (none for the first)."""
    ids = [i for i in _versions(spark, path) if i < batch_id]
    return spark.read.schema(schema).parquet(f"{path}/batch-{ids[-1]}") if ids else None

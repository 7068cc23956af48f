"""The given tables seen as telemetry, state tables and messages.

``events`` is read as long telemetry (its users are devices), ``supplier`` as the fleet registry,
``orders`` as alert history and labels, ``lineitem`` as work orders, ``part`` as model versions.
Every view covers its whole source table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from pulsegrid import fixed
from pulsegrid.dims import registry as registry_view
from pulsegrid.functions.grid import bin_index, bin_start, rounded, seconds
from pulsegrid.operators.messages import status_flags

VARIABLE_OF = {"click": 635, "view": 2782, "purchase": 2098, "signup": 2097, "error": 1889}
STATUS_OF = {"click": 801, "view": 802, "purchase": 803, "signup": 804}
IDS = list(VARIABLE_OF.values())
NUMERIC = ["var_635", "var_2782", "var_2098", "var_2097", "fio2_deviation", "o2_air_pressure_ratio"]
FREQ, GAP, WINDOW, STEP = "6h", "24h", "36h", "6h"
SLICE_BINS = 28  # a week of six-hour bins, so slice borders occur in the given month
SLICE = "7d"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; local timestamps are taken as UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    local = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in local}) if local else df


def tidy(df: DataFrame, digits: int | None = 6) -> DataFrame:
    """Doubles rounded, days as text and timestamps without zone, for comparison with another
    engine."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.DoubleType) and digits is not None:
            out[f.name] = rounded(F.col(f.name), digits)
        elif isinstance(f.dataType, T.DateType):
            out[f.name] = F.col(f.name).cast("string")
        elif isinstance(f.dataType, T.TimestampType):
            out[f.name] = F.col(f.name).cast("timestamp_ntz")
    return df.withColumns(out) if out else df


def _mapped(column: str, table_: dict[str, int]) -> Column:
    out = F.lit(None).cast("int")
    for name, number in table_.items():
        out = F.when(F.col(column) == name, number).otherwise(out)
    return out


def serial(key: str) -> Column:
    return F.lpad(F.col(key).cast("string"), 15, "0")


def packed() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def telemetry(spark: SparkSession, sf_dir: str, status: bool = True) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    if status:
        ev = ev.withColumn("k", packed())
    standby = F.when(F.col("value") > 50, 1.0).otherwise(0.0)
    flags = {}
    if status:
        source = _mapped("event_type", STATUS_OF).cast("string")
        flags = status_flags(F.coalesce(source, F.lit("")), F.col("k"))
    return ev.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        serial("user_id").alias("device_serial"),
        _mapped("event_type", VARIABLE_OF).alias("variable_id"),
        F.when(F.col("event_type") == "error", standby).otherwise(F.col("value")).alias("value"),
        *[flags[c].alias(c) for c in fixed.STATUS_FEATURES if c in flags],
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup = table(spark, sf_dir, "supplier")
    return registry_view(
        spark,
        sup.select(F.col("s_suppkey").cast("int").alias("cmms_reg"), F.col("s_name").alias("cmms_serial")),
    )


def failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One failure per device: the day of its error event with the largest value."""
    ev = table(spark, sf_dir, "events").where("event_type = 'error'")
    worst = F.max_by(F.struct("event_id", "ts", "props"), F.struct("value", -F.col("event_id")))
    return ev.groupBy("user_id").agg(worst.alias("w")).select(
        F.col("w.event_id").alias("event_id"),
        serial("user_id").alias("device_serial"),
        F.col("user_id").cast("int").alias("cmms_reg"),
        F.to_date("w.ts").alias("event_date"),
        F.concat(F.lit("error "), F.col("w.props")).alias("description"),
    )


def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scheduled services: every signup event's device and day."""
    ev = table(spark, sf_dir, "events").where("event_type = 'signup'")
    return ev.select(
        "event_id",
        serial("user_id").alias("device_serial"),
        F.col("user_id").cast("int").alias("cmms_reg"),
        F.to_date("ts").alias("event_date"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic scores: mean reading per device and six-hour bin."""
    step = seconds(FREQ)
    binned = (
        telemetry(spark, sf_dir, status=False)
        .where(F.col("variable_id") != fixed.STANDBY_VARIABLE)
        .groupBy("device_serial", bin_index(F.col("timestamp"), step).alias("bin"))
        .agg(rounded(F.avg("value"), 6).alias("anomaly_score"))
    )
    return binned.select(
        "device_serial",
        bin_start(F.col("bin"), step).alias("window_start"),
        bin_start(F.col("bin") + 1, step).alias("window_end"),
        bin_start(F.col("bin") + 1, step).alias("timestamp"),
        "anomaly_score",
    )


def alert_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "critical")
        .when(F.col("o_orderpriority") == "2-HIGH", "warning")
        .otherwise("normal")
    )
    sent = F.col("o_orderstatus") == "F"
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        serial("o_custkey").alias("device_serial"),
        F.col("o_orderdate").alias("timestamp"),
        level.alias("alert_level"),
        (F.col("o_totalprice") / 100000).alias("anomaly_score"),
        F.least(F.col("o_totalprice") / 500000, F.lit(1.0)).alias("fleet_percentile"),
        sent.alias("notified"),
        F.when(sent, F.col("o_orderdate") + F.expr("interval 6 hours")).alias("notified_at"),
    )


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("o_orderstatus") == "F", "confirmed_fault")
        .when(F.col("o_orderstatus") == "P", "scheduled_pv")
        .otherwise("unrelated")
    )
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        serial("o_custkey").alias("device_serial"),
        F.to_date("o_orderdate").alias("date"),
        kind.alias("event_type"),
        F.concat(F.lit("WO"), F.col("o_orderkey").cast("string")).alias("work_order_id"),
        F.when(kind != "unrelated", F.col("o_orderkey")).alias("matched_alert_id"),
        F.col("o_orderpriority").alias("notes"),
        F.col("o_orderdate").alias("created_at"),
        F.lit("manual").alias("source"),
    )


def raw_work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a work-order export with its original headers; ids repeat."""
    kind = (
        F.when(F.col("l_returnflag") == "R", "Korrektiv")
        .when(F.col("l_returnflag") == "A", " Forebyggende ")
        .otherwise("Kalibrering")
    )
    ship = F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("AO-nr."),
        kind.alias("AO-type"),
        ship.alias("Reg. dato"),
        F.when(F.col("l_linestatus") == "F", ship).alias("Ferdig"),
        F.concat(F.lit("quantity "), F.col("l_quantity").cast("int")).alias("Oppgave/feilbeskrivelse"),
        F.when(F.col("l_discount") > 0.05, "discounted").alias("Teknisk beskrivelse"),
        F.when(F.col("l_tax") > 0, F.col("l_suppkey").cast("string")).alias("Reg.nr."),
        F.concat(F.lit("SN"), F.col("l_partkey").cast("string")).alias("Serienr."),
    )


def work_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored work orders, one per order key: facts of the line with the smallest sort key."""
    first = F.min(
        F.struct("l_linenumber", "l_shipdate", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity")
    )
    kind = (
        F.when(F.col("w.l_returnflag") == "R", "corrective")
        .when(F.col("w.l_returnflag") == "A", "preventive")
        .otherwise("kalibrering")
    )
    grouped = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(first.alias("w"))
    return grouped.select(
        F.concat(F.lit("WO"), F.col("l_orderkey").cast("string")).alias("work_order_id"),
        kind.alias("work_order_type"),
        F.to_date("w.l_shipdate").alias("registered_date"),
        F.when(F.col("w.l_linestatus") == "F", F.to_date("w.l_shipdate")).alias("completed_date"),
        F.concat(F.lit("quantity "), F.col("w.l_quantity").cast("int")).alias("fault_description"),
        F.lit("").alias("technical_description"),
        F.col("w.l_suppkey").cast("int").alias("device_reg"),
        F.concat(F.lit("SN"), F.col("w.l_suppkey").cast("string")).alias("serial_number"),
        F.lit("export.csv").alias("import_filename"),
        F.col("w.l_shipdate").alias("imported_at"),
        (F.col("w.l_linestatus") == "F").alias("matched"),
    )


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    job = (
        F.when(F.col("event_type") == "click", "daily_inference")
        .when(F.col("event_type") == "view", "health_check")
        .otherwise("label_matcher")
    )
    failed = F.col("value") > 60
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        job.alias("job_name"),
        F.when(failed, "failure").otherwise("success").alias("status"),
        F.round(F.col("value") * 1000).cast("bigint").alias("duration_ms"),
        packed().cast("bigint").alias("rows_processed"),
        F.when(failed, F.col("props")).alias("error_message"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    newest = part.select(F.max("p_partkey")).scalar()
    start = F.lit("2024-01-01").cast("timestamp")
    return part.select(
        F.col("p_partkey").alias("version_id"),
        F.timestamp_micros(F.unix_micros(start) + F.col("p_partkey") * F.lit(3_600_000_000)).alias(
            "trained_at"
        ),
        F.col("p_size").alias("label_count"),
        F.floor(F.col("p_size") / 3).cast("int").alias("confirmed_count"),
        F.col("p_name").alias("model_path"),
        F.col("p_type").alias("performance_snapshot"),
        (F.col("p_partkey") == newest).alias("active"),
    )


def attribution_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        serial("user_id").alias("device_serial"),
        F.col("ts").alias("computed_at"),
        text(F.col("ts") - F.expr("interval 1 day")).alias("window_start"),
        text(F.col("ts")).alias("window_end"),
        F.col("props").alias("result_json"),
    )


def messages(spark: SparkSession, sf_dir: str, located: bool = False) -> DataFrame:
    """One device message per event: ``(src, pos, timestamp, message)``; if ``located`` with the piece
    of a file that holds it, ``(file, block)``.

    The gateway (``src``) follows the event type, so each source is a fifth of the table. Low
    readings come from another device model, some messages lack the serial number, some times
    are cut short."""
    ev = table(spark, sf_dir, "events").withColumn("k", packed())
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
    model = F.when(F.col("value") >= 10, "Elisa 800").otherwise("Elisa 500")
    at = F.date_format("ts", "yyyyMMddHHmmss")
    seen = F.when(F.col("k") == 13, F.substring(at, 1, 8)).when(
        F.col("k") == 14, F.concat(F.lit("20241399"), F.substring(at, 9, 6))
    ).otherwise(at)
    unit = F.when(F.col("event_type") == "click", "19").when(F.col("event_type") == "view", "42").otherwise("")
    mode = F.when(F.col("k") < 30, "p").when(F.col("k") < 60, "vv").otherwise("??")
    status = F.coalesce(_mapped("event_type", STATUS_OF), F.lit(801)).cast("string")
    word = F.when(F.col("k") == 15, "n/a").otherwise(F.col("k").cast("string"))

    def obx(no: str, kind: str, name, value, unit_: Column | None = None) -> Column:
        parts = [F.lit(f"OBX|{no}|{kind}|"), name, F.lit("^x^L|1|"), value, F.lit("|"),
                 unit_ if unit_ is not None else F.lit(""), F.lit("|||||F|||"), seen]
        return F.concat(*parts)

    number = _mapped("event_type", VARIABLE_OF).cast("string")
    own = F.when(F.col("k") < 60, obx("5", "CWE", F.lit("1913"), serial("user_id")))
    return ev.select(
        F.concat(F.lit("gw-"), F.col("event_type")).alias("src"),
        F.col("event_id").alias("pos"),
        F.col("ts").alias("timestamp"),
        F.concat_ws(
            "\r",
            F.concat(F.lit("MSH|^~\\&|DEV|SITE|RCV|SVC|"), at, F.lit("||ORU^R01|"),
                     F.col("event_id").cast("string"), F.lit("|P|2.3")),
            F.lit("PID|1||X"),
            F.concat(F.lit("OBR|1|R|F|999^"), model, F.lit("^L")),
            obx("1", "NM", number, F.col("value").cast("string"), unit),
            obx("2", "NM", status, word),
            obx("3", "CWE", F.lit("584"), mode),
            obx("4", "NM", F.lit("2046"), F.when(F.col("k") < 50, "0").otherwise("1")),
            own,
        ).alias("message"),
        *(place if located else []),
    )

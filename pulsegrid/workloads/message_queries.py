"""Queries over device messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid import fixed
from pulsegrid.functions.text import status_column
from pulsegrid.operators import messages as ms
from pulsegrid.session import scratch_path
from pulsegrid.sources import messages as src
from pulsegrid.workloads import adapter as ad
from pulsegrid.workloads.registry import query
from pulsegrid.workloads.views_sql import sql

_BITS = {
    s: [(b, n) for v, b, n in fixed.STATUS_BITS if v == s] for s in fixed.STATUS_IDS
}
_WORD = "TRY_CAST(value AS BIGINT)"


def _bit(b):
    return f"(({_WORD} >> {b}) & 1) = 1"


def _flag_sql(v, b, n):
    return f"coalesce(variable_id = '{v}' AND {_bit(b)}, false) AS {status_column(n)}"


_FLAGS = ", ".join(_flag_sql(*x) for x in fixed.STATUS_BITS)
_JSON = (
    f"CASE WHEN {_WORD} IS NULL THEN '' ELSE CASE variable_id "
    + " ".join(
        f"WHEN '{s}' THEN '{{' || "
        + " || ',' || ".join(
            f"'\"{n}\":' || CASE WHEN {_bit(b)} THEN 'true' ELSE 'false' END" for b, n in bits
        )
        + " || '}'"
        for s, bits in _BITS.items()
    )
    + " ELSE '' END END"
)
_TIME = "CASE WHEN length(timestamp) >= 14 THEN try_strptime(substr(timestamp, 1, 14), '%Y%m%d%H%M%S') END"


def _parsed(spark, sf):
    read = ad.messages(spark, sf, located=True).drop("timestamp")
    known = ms.assign_serial_in_place(read, ["pos"], ["file", "block"])
    return ms.with_segments(known.drop("file", "block"))


def _observations(spark, sf):
    return ms.observations(_parsed(spark, sf))


def _enriched(spark, sf):
    return ms.enrich(_observations(spark, sf))


@query(
    "hl7_messages",
    sql("SELECT CAST(pos AS VARCHAR) AS control_id, replace(message, chr(13), chr(10)) AS message FROM messages"),
)
def hl7_messages(spark, sf):
    """Messages written as plain text captures and read back."""
    path = scratch_path(spark, "captures")
    ad.messages(spark, sf).select(F.regexp_replace("message", "\r", "\n")).write.text(path)
    read = src.read_message_files(spark, path)
    return read.select(ms.control_id(F.col("message")).alias("control_id"), "message")


@query("mllp_deframe", sql("SELECT CAST(pos AS VARCHAR) AS control_id, message FROM messages"))
def mllp_deframe(spark, sf):
    """Messages written as framed captures and read back."""
    path = scratch_path(spark, "frames")
    src.write_frames(ad.messages(spark, sf), path)
    read = src.read_frames(spark, path)
    return read.select(ms.control_id(F.col("message")).alias("control_id"), "message")


@query(
    "hl7_header",
    sql("SELECT src, pos, coalesce(string_split(segs[1], '|')[10], '') AS control_id, CAST(len(segs) AS INTEGER) AS n_segments FROM parsed"),
)
def hl7_header(spark, sf):
    df = ms.with_segments(ad.messages(spark, sf))
    return df.select(
        "src", "pos", ms.control_id(F.col("message")).alias("control_id"),
        F.size("segments").alias("n_segments"),
    )


@query(
    "hl7_gate",
    sql("SELECT src, pos, len(list_filter(segs, lambda s: s LIKE 'OBR%^Elisa 800%')) > 0 AS accepted FROM parsed"),
)
def hl7_gate(spark, sf):
    df = ms.with_segments(ad.messages(spark, sf))
    return df.select("src", "pos", ms.passes_gate(F.col("segments")).alias("accepted"))


@query("serial_carry", sql("SELECT src, pos, device_serial FROM parsed"))
def serial_carry(spark, sf):
    return _parsed(spark, sf).select("src", "pos", "device_serial")


@query("hl7_obx", sql("SELECT * FROM obx"))
def hl7_obx(spark, sf):
    return _observations(spark, sf)


@query("catalog_enrich", sql("SELECT src, pos, obx, variable_id, value, label, unit, unit_short FROM enriched"))
def catalog_enrich(spark, sf):
    return _enriched(spark, sf).select(
        "src", "pos", "obx", "variable_id", "value", "label", "unit", "unit_short"
    )


@query("value_description", sql("SELECT src, pos, obx, variable_id, value, value_description FROM enriched"))
def value_description(spark, sf):
    return _enriched(spark, sf).select("src", "pos", "obx", "variable_id", "value", "value_description")


@query(
    "hl7_time",
    sql(f"""SELECT src, pos, obx, timestamp AS raw, {_TIME} AS timestamp,
        epoch_us({_TIME}) * 1000 AS epoch_ns FROM obx"""),
)
def hl7_time(spark, sf):
    raw = F.col("raw")
    return _observations(spark, sf).withColumnRenamed("timestamp", "raw").select(
        "src", "pos", "obx", "raw", ms.message_time(raw).alias("timestamp"),
        ms.epoch_ns(raw).alias("epoch_ns"),
    )


@query(
    "hl7_quarantine",
    sql("""SELECT src, pos, device_serial, count(*) AS n_segments FROM obx WHERE length(timestamp) >= 14
        AND try_strptime(substr(timestamp, 1, 14), '%Y%m%d%H%M%S') IS NULL GROUP BY ALL"""),
)
def hl7_quarantine(spark, sf):
    bad = ms.unreadable(_parsed(spark, sf))
    return bad.groupBy("src", "pos", "device_serial").agg(F.count(F.lit(1)).alias("n_segments"))


_STATUS_ROWS = "variable_id IN ('801', '802', '803', '804')"


@query("bitfield_decode", sql(f"SELECT src, pos, variable_id, value, {_FLAGS} FROM obx WHERE {_STATUS_ROWS}"))
def bitfield_decode(spark, sf):
    words = _observations(spark, sf).where(F.col("variable_id").isin("801", "802", "803", "804"))
    flags = ms.status_flags(F.col("variable_id"), F.col("value"))
    return words.select(
        "src", "pos", "variable_id", "value", *[c.alias(n) for n, c in flags.items()]
    )


@query("bitfield_json", sql(f"SELECT src, pos, obx, variable_id, value, {_JSON} AS bitfield_status FROM obx"))
def bitfield_json(spark, sf):
    status = ms.status_map(F.col("variable_id"), F.col("value"))
    return _observations(spark, sf).select(
        "src", "pos", "obx", "variable_id", "value", ms.status_json(status).alias("bitfield_status")
    )


_ROWS = f"""variable_id, device_serial, label, value, value_description, unit, unit_short,
  timestamp AS timestamp_str, {_FLAGS}"""


@query(
    "telemetry_rows",
    sql(f"SELECT {_ROWS}, {_TIME} AS timestamp, CAST({_TIME} AS DATE) AS day FROM enriched"),
    dates=("day",),
)
def telemetry_rows(spark, sf):
    return ms.telemetry_rows(_enriched(spark, sf))


_TEXT = ["label", "value", "value_description", "unit", "unit_short", "timestamp_str"]


def _text_item(c):
    source = "timestamp" if c == "timestamp_str" else c
    return f"CASE WHEN {source} <> '' THEN '{c}=\"' || replace({source}, '\"', '\\\"') || '\"' END"


def _flag_item(v, b, n):
    flag = _flag_sql(v, b, n).rsplit(" AS ", 1)[0]
    return f"'{status_column(n)}=' || CASE WHEN {flag} THEN 't' ELSE 'f' END"


_ITEMS = ", ".join([_text_item(c) for c in _TEXT] + [_flag_item(*x) for x in fixed.STATUS_BITS])


@query(
    "line_protocol",
    sql(f"""SELECT concat_ws(' ', '{fixed.MEASUREMENT_NAME},variable_id=' || variable_id || ',device_serial=' || device_serial,
        concat_ws(',', {_ITEMS}), CAST(epoch_us({_TIME}) * 1000 AS VARCHAR)) AS value FROM enriched"""),
)
def line_protocol(spark, sf):
    return ms.line_protocol(ms.telemetry_rows(_enriched(spark, sf)))

"""Device messages to observations and stored rows.

A message is one text value. Its segments stay an array column until the observation segments
are exploded, so gate, header and serial number are found without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid import dims, fixed
from pulsegrid.functions.text import status_column
from pulsegrid.operators.ordered import carry_in_place, carry_last, pin_splits


def segments(message: Column) -> Column:
    """Trimmed non-empty lines of a message; CR and LF both end a line."""
    lines = F.split(F.regexp_replace(message, "\r", "\n"), "\n")
    return F.filter(F.transform(lines, lambda s: F.trim(s, F.lit(" \t"))), lambda s: s != "")


def _field(parts: Column, index: int) -> Column:
    """Field by 0-based position, null when the segment is shorter."""
    return F.get(parts, F.lit(index))


def control_id(message: Column) -> Column:
    """Header field 9, empty when absent."""
    lines = F.split(F.regexp_replace(message, "\r", "\n"), "\n")
    long_enough = lambda s: s.startswith("MSH") & (F.size(F.split(s, r"\|")) > 9)
    header = F.get(F.filter(lines, long_enough), F.lit(0))
    return F.coalesce(_field(F.split(header, r"\|"), 9), F.lit(""))


def passes_gate(segs: Column, marker: str = fixed.DEVICE_MARKER) -> Column:
    """True when some order segment names the device model."""
    requests = F.filter(segs, lambda s: s.startswith("OBR"))
    return F.exists(
        requests, lambda s: F.exists(F.split(s, r"\|"), lambda f: f.contains(F.lit(marker)))
    )


def _root(field: Column) -> Column:
    return F.substring_index(field, "^", 1)


def message_serial(message: Column, variable: str = fixed.SERIAL_VARIABLE) -> Column:
    """Last non-empty serial number observation of the message text, null without one."""
    name = rf"[ \t]*{variable}(?:[ \t]*|\^[^|\r\n]*)"
    found = F.regexp_extract_all(
        message,
        F.lit(rf"(?m)^[ \t]*OBX\|[^|\r\n]*\|[^|\r\n]*\|{name}\|[^|\r\n]*\|([^|^\r\n]*)"),
    )
    values = F.filter(F.transform(found, lambda v: F.trim(v)), lambda v: v != "")
    return F.element_at(F.concat(F.array(F.lit(None).cast("string")), values), -1)


def with_segments(messages: DataFrame) -> DataFrame:
    return messages.withColumn("segments", segments(F.col("message")))


def assign_serial(
    messages: DataFrame, order: list[str] | None = None, slice_col: str | None = None, chunk: int = 4096
) -> DataFrame:
    """Serial of each message: its own, else the last one seen before it on the same source.

    Messages of rejected device models carry serials forward too. A source is cut into slices
    (``slice_col``, or ranges of ``pos``), so one busy source is spread over many tasks."""
    order = order or ["pos"]
    df = messages.withColumn("_own", message_serial(F.col("message")))
    if slice_col is None:
        df = df.withColumn("_part", F.floor(F.col(order[0]) / F.lit(chunk)).cast("bigint"))
    else:
        df = df.withColumn("_part", F.col(slice_col))
    carried = carry_last(df, ["src"], order, "_part", "_own", "device_serial")
    return carried.withColumn(
        "device_serial", F.coalesce("device_serial", F.lit("unknown"))
    ).drop("_own", "_part")


def assign_serial_in_place(
    messages: DataFrame,
    order: list[str] | None = None,
    slices: list[str] | None = None,
    slice_col: str | None = None,
    min_tasks: int | None = None,
) -> DataFrame:
    """As :func:`assign_serial`, for messages as they are read from files: no message is shuffled.

    ``slices`` (default: ``block``) name the piece of a file a message was read from. Where slices
    of one source overlap in ``order`` (default: ``seq``, ``part``), messages are shuffled after all, by
    ``slice_col`` or ranges of the first order column; so are files that fewer than ``min_tasks``
    (default: the cores at hand) tasks read, which a shuffle spreads. Either way gives the same."""
    order, slices = order or ["seq", "part"], slices or ["block"]
    spark = messages.sparkSession
    pin_splits(spark)
    if min_tasks is None:
        min_tasks = spark.sparkContext.defaultParallelism
    if messages.rdd.getNumPartitions() < min_tasks:
        return assign_serial(messages, order, slice_col)
    df = messages.withColumn("_own", message_serial(F.col("message")))
    filled = carry_in_place(df, ["src"], order, slices, "_own", "device_serial")
    if filled is None:
        return assign_serial(messages, order, slice_col)
    return filled.withColumn("device_serial", F.coalesce("device_serial", F.lit("unknown"))).drop("_own")


def observations(
    messages: DataFrame,
    marker: str = fixed.DEVICE_MARKER,
    unit_field: int = 6,
    time_field: int = 14,
) -> DataFrame:
    """One row per observation segment of the accepted messages, untouched text values.

    Expects ``segments``; columns of the message ride along. Segments without a value field
    cannot be read and are left out (see :func:`unreadable`)."""
    keep = [c for c in messages.columns if c not in ("message", "segments")]
    obx = F.filter("segments", lambda s: s.startswith("OBX"))
    rows = (
        messages.where(passes_gate(F.col("segments"), marker))
        .select(*keep, F.posexplode(obx).alias("_obx", "_line"))
        .withColumn("_f", F.split("_line", r"\|"))
        .where(F.size("_f") > 5)
    )
    return rows.select(
        *keep,
        F.col("_obx").alias("obx"),
        _root(F.trim(_field(F.col("_f"), 3))).alias("variable_id"),
        _field(F.col("_f"), 5).alias("value"),
        F.nullif(_field(F.col("_f"), unit_field), F.lit("")).alias("unit"),
        F.coalesce(_field(F.col("_f"), time_field), F.lit("")).alias("timestamp"),
    )


def message_time(ts: Column, zone: str | None = None) -> Column:
    """Fourteen leading digits to a timestamp; short or malformed text gives null."""
    parsed = F.try_to_timestamp(F.substring(ts, 1, 14), F.lit("yyyyMMddHHmmss"))
    parsed = F.when(F.length(ts) >= 14, parsed)
    return parsed if zone is None else F.to_utc_timestamp(parsed, zone)


def epoch_ns(ts: Column) -> Column:
    return F.unix_micros(message_time(ts)) * F.lit(1000)


def unreadable(messages: DataFrame, time_field: int = 14, marker: str = fixed.DEVICE_MARKER) -> DataFrame:
    """Observation segments that are too short or carry a malformed time, for quarantine."""
    keep = [c for c in messages.columns if c not in ("message", "segments")]
    obx = F.filter("segments", lambda s: s.startswith("OBX"))
    rows = messages.where(passes_gate(F.col("segments"), marker)).select(
        *keep, F.explode(obx).alias("line")
    )
    parts = F.split("line", r"\|")
    ts = _field(parts, time_field)
    bad_time = (F.length(ts) >= 14) & message_time(ts).isNull()
    return rows.where((F.size(parts) <= 5) | F.coalesce(bad_time, F.lit(False)))


def value_text(variable: Column, label: Column, value: Column, code_text: Column) -> Column:
    """Readable value: coded values by their table, alarm-like labels as on/off, else raw."""
    coded = variable.isin(list(fixed.CODED_VALUES))
    alarm = F.lower(label).rlike("|".join(fixed.ALARM_WORDS))
    on_off = dims.lookup(fixed.ON_OFF_TEXT, value)
    return F.when(coded, F.coalesce(code_text, value)).when(alarm, F.coalesce(on_off, value)).otherwise(value)


def enrich(obs: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Add label, unit, short unit and readable value from the catalogs.

    Code and unit tables are bounded constants and broadcast; a site catalog is joined as it is."""
    spark = obs.sparkSession
    names = F.broadcast(dims.labels(spark)) if catalog is None else catalog
    names = names.select("variable_id", F.col("label").alias("_label"), F.col("unit").alias("_unit"))
    codes = F.broadcast(dims.codes(spark)).select(
        "variable_id", F.col("code").alias("value"), F.col("text").alias("_text")
    )
    units = F.broadcast(dims.units(spark)).select(
        F.col("code").alias("unit"), F.col("unit").alias("_short")
    )
    keep = [c for c in obs.columns if c != "unit"]
    named = obs.join(names, "variable_id", "left").withColumns(
        {
            "label": F.coalesce("_label", "variable_id"),
            "unit": F.coalesce("unit", "_unit", F.lit("")),
        }
    )
    joined = named.join(codes, ["variable_id", "value"], "left").join(units, "unit", "left")
    return joined.select(
        *keep,
        "label",
        "unit",
        F.coalesce("_short", F.lit("")).alias("unit_short"),
        value_text(F.col("variable_id"), F.col("label"), F.col("value"), F.col("_text")).alias(
            "value_description"
        ),
    )


def status_map(variable: Column, value: Column) -> Column:
    """Status bits of a packed word as map name -> boolean; null for other variables and an empty
    map for words that are no integer."""
    word = value.try_cast("bigint")
    out = F.lit(None).cast("map<string,boolean>")
    for source in fixed.STATUS_IDS:
        bits = [(b, n) for v, b, n in fixed.STATUS_BITS if v == source]
        pairs = [x for b, n in bits for x in (F.lit(n), F.getbit(word, F.lit(b)) == 1)]
        empty = F.create_map().cast("map<string,boolean>")
        decoded = F.when(word.isNull(), empty).otherwise(F.create_map(*pairs))
        out = F.when(variable == str(source), decoded).otherwise(out)
    return out


def status_json(status: Column) -> Column:
    """JSON text of a decoded status, empty without bits."""
    return F.when(F.coalesce(F.size(status), F.lit(0)) > 0, F.to_json(status)).otherwise("")


def status_flags(variable: Column, value: Column, default: bool | None = False) -> dict[str, Column]:
    """The 17 status columns of a stored row; a row that is not a status word holds ``default``."""
    word = value.try_cast("bigint")
    return {
        status_column(name): F.when(
            (variable == str(source)) & word.isNotNull(), F.getbit(word, F.lit(bit)) == 1
        ).otherwise(F.lit(default).cast("boolean"))
        for source, bit, name in fixed.STATUS_BITS
    }


def telemetry_rows(enriched: DataFrame) -> DataFrame:
    """Rows of the raw telemetry table: text fields, 17 status columns, time and day."""
    flags = status_flags(F.col("variable_id"), F.col("value"))
    at = message_time(F.col("timestamp"))
    return enriched.select(
        "variable_id",
        "device_serial",
        "label",
        "value",
        "value_description",
        "unit",
        "unit_short",
        F.col("timestamp").alias("timestamp_str"),
        *[c.alias(n) for n, c in flags.items()],
        at.alias("timestamp"),
        F.to_date(at).alias("day"),
    )


def line_protocol(
    rows: DataFrame,
    measurement: str = fixed.MEASUREMENT_NAME,
    tags: tuple[str, ...] = ("variable_id", "device_serial"),
    time_ns: Column | None = None,
) -> DataFrame:
    """Text export lines; empty and null fields are skipped, rows without any field are dropped."""
    def tag(c: str) -> Column:
        safe = F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), " ", "_"), "[,=]", "")
        return F.concat(F.lit(f"{c}="), safe)

    def item(field) -> Column:
        c, kind = F.col(field.name), field.dataType.typeName()
        if kind == "boolean":
            shown = F.when(c, "t").when(~c, "f")
        elif kind == "string":
            text = F.replace(c, F.lit('"'), F.lit('\\"'))
            shown = F.when(c != "", F.concat(F.lit('"'), text, F.lit('"')))
        else:
            shown = c.cast("string")
        return F.when(shown.isNotNull(), F.concat(F.lit(f"{field.name}="), shown))

    skip = {*tags, "timestamp", "day"}
    shown = [f for f in rows.schema.fields if f.name not in skip]
    filled = F.lit(False)
    for f in sorted(shown, key=lambda f: f.dataType.typeName() != "boolean"):
        present = F.col(f.name).isNotNull()
        text = f.dataType.typeName() == "string"
        filled = filled | ((present & (F.col(f.name) != "")) if text else present)
    at = F.unix_micros("timestamp") * F.lit(1000) if time_ns is None else time_ns
    fields = F.concat_ws(",", *[item(f) for f in shown])
    head = F.concat(F.lit(measurement), *[F.concat(F.lit(","), tag(c)) for c in tags])
    return rows.where(filled).select(
        F.concat_ws(" ", head, fields, at.cast("string")).alias("value")
    )

"""Queries over the long table: sources, cleaning, registry."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsegrid import dims, fixed
from pulsegrid.functions.text import human_name, normalize_serial
from pulsegrid.operators import clean
from pulsegrid.session import scratch_path
from pulsegrid.sources import telemetry as src
from pulsegrid.workloads import adapter as ad
from pulsegrid.workloads.registry import query
from pulsegrid.workloads.views_sql import STATUS, r6, sql

LONG = ["device_serial", "timestamp", "variable_id", "value"]
LONG_SQL = "device_serial, timestamp, variable_id, round(value + 1e-10, 6) + 0.0 AS value"
FROM, UNTIL = "2024-01-08", "2024-01-22"


def _stored(spark, sf):
    path = scratch_path(spark, "telemetry")
    src.write_daily(ad.telemetry(spark, sf), path)
    return path


@query("load_fleet", sql(f"SELECT {LONG_SQL}, CAST(timestamp AS DATE) AS day FROM telemetry"), dates=("day",))
def load_fleet(spark, sf):
    return src.load_fleet(spark, _stored(spark, sf)).select(*LONG, "day")


@query(
    "load_recent",
    sql(f"SELECT {LONG_SQL}, CAST(timestamp AS DATE) AS day FROM telemetry "
        "WHERE CAST(timestamp AS DATE) IN (SELECT DISTINCT CAST(ts AS DATE) FROM events ORDER BY 1 DESC LIMIT 3)"),
    dates=("day",),
)
def load_recent(spark, sf):
    return src.load_recent(spark, _stored(spark, sf), dt.date(2025, 1, 1), 3).select(*LONG, "day")


@query(
    "load_event_span",
    sql(f"""SELECT f.event_id, f.cmms_reg, t.device_serial, t.timestamp, t.variable_id, {r6('t.value')}
        FROM telemetry t JOIN failures f ON f.device_serial = t.device_serial
        AND CAST(t.timestamp AS DATE) BETWEEN f.event_date - 15 AND f.event_date + 3"""),
)
def load_event_span(spark, sf):
    stored = spark.read.parquet(_stored(spark, sf)).drop("event_id")
    span = src.load_event_span(stored, ad.failures(spark, sf))
    return span.select("event_id", "cmms_reg", *LONG)


@query(
    "scan_range",
    sql(f"""SELECT {LONG_SQL} FROM telemetry WHERE timestamp >= TIMESTAMP '{FROM}'
        AND timestamp < TIMESTAMP '{UNTIL}' AND variable_id IN (635, 2782)
        AND device_serial IN (SELECT device_serial FROM registry)"""),
)
def scan_range(spark, sf):
    fleet = clean.fleet_only(ad.telemetry(spark, sf, status=False), ad.registry(spark, sf))
    return clean.scan_range(fleet, FROM, UNTIL, variables=[635, 2782]).select(*LONG)


@query("time_range", sql("SELECT min(timestamp) AS min_ts, max(timestamp) AS max_ts FROM telemetry"))
def time_range(spark, sf):
    return clean.time_range(ad.telemetry(spark, sf, status=False))


_EXTRACT = f"""FROM telemetry WHERE timestamp >= TIMESTAMP '2024-01-05' AND timestamp < TIMESTAMP '2024-01-26'
  AND device_serial IN (SELECT device_serial FROM registry)"""


def _extracted(spark, sf):
    path = scratch_path(spark, "extract")
    raw = ad.telemetry(spark, sf).withColumn("value", F.col("value").cast("string"))
    src.extract_daily(raw, path, ad.registry(spark, sf), "2024-01-05", "2024-01-25")
    return spark.read.parquet(path)


@query(
    "extract_daily",
    sql(f"SELECT {LONG_SQL}, CAST(timestamp AS DATE) AS day, "
        + ", ".join(f"CAST({c} AS TINYINT) AS {c}" for c in STATUS) + f" {_EXTRACT}"),
    dates=("day",),
)
def extract_daily(spark, sf):
    return _extracted(spark, sf).select(*LONG, "day", *STATUS)


@query(
    "extract_manifest",
    sql(f"""SELECT count(*) AS total_rows, count(DISTINCT CAST(timestamp AS DATE)) AS n_chunks,
        '2024-01-05' AS exclude_before, (SELECT count(*) FROM registry) AS fleet_size,
        'all' AS n_variable_ids {_EXTRACT}"""),
)
def extract_manifest(spark, sf):
    return src.manifest(_extracted(spark, sf), ad.registry(spark, sf), "2024-01-05")


@query(
    "clean_long",
    sql(f"""SELECT {LONG_SQL.replace('value +', "CASE WHEN variable_id = 1889 AND value = 0 THEN NULL ELSE value END +")},
        {', '.join(f'CAST({c} AS TINYINT) AS {c}' for c in STATUS)}
        FROM telemetry WHERE device_serial IN (SELECT device_serial FROM registry)"""),
)
def clean_long(spark, sf):
    text = F.col("value").cast("string")
    off = (F.col("variable_id") == fixed.STANDBY_VARIABLE) & (F.col("value") == 0)
    raw = ad.telemetry(spark, sf).withColumns(
        {
            "value": F.when(off & (F.col("event_id") > 500), "off").when(off, "NaN").otherwise(text),
            "variable_id": F.col("variable_id").cast("string"),
            "timestamp": F.col("timestamp").cast("string"),
        }
    )
    return clean.clean_long(raw, ad.registry(spark, sf)).select(*LONG, *STATUS)


@query("fleet_semi", sql(f"SELECT event_id, {LONG_SQL} FROM telemetry WHERE device_serial IN (SELECT device_serial FROM registry)"))
def fleet_semi(spark, sf):
    df = clean.fleet_only(ad.telemetry(spark, sf, status=False), ad.registry(spark, sf))
    return df.select("event_id", *LONG)


@query("fleet_anti", sql("SELECT DISTINCT device_serial FROM telemetry WHERE device_serial NOT IN (SELECT device_serial FROM registry)"))
def fleet_anti(spark, sf):
    return clean.unknown_devices(ad.telemetry(spark, sf, status=False), ad.registry(spark, sf))


@query("serial_normalize", """
SELECT c_custkey, lpad(right(regexp_replace(c_name, '[^0-9]', '', 'g'), 7), 15, '0') AS device_serial FROM customer""")
def serial_normalize(spark, sf):
    customer = ad.table(spark, sf, "customer")
    return customer.select("c_custkey", normalize_serial(F.col("c_name")).alias("device_serial"))


@query(
    "registry_lookup",
    sql("""SELECT w.work_order_id, w.device_reg, g.device_serial, g.cmms_serial
        FROM work_orders w LEFT JOIN registry g ON g.cmms_reg = w.device_reg"""),
)
def registry_lookup(spark, sf):
    reg = ad.registry(spark, sf).withColumnRenamed("cmms_reg", "device_reg")
    return ad.work_orders(spark, sf).join(reg, "device_reg", "left").select(
        "work_order_id", "device_reg", "device_serial", "cmms_serial"
    )


@query(
    "union_days",
    sql(f"""SELECT {LONG_SQL}, CAST(bitfield_gas_supplies_ok AS INTEGER) AS gas_supplies_ok FROM telemetry WHERE timestamp < TIMESTAMP '2024-01-16'
        UNION ALL SELECT {LONG_SQL}, NULL FROM telemetry WHERE timestamp >= TIMESTAMP '2024-01-16'"""),
)
def union_days(spark, sf):
    df = ad.telemetry(spark, sf)
    early = clean.scan_range(df, end="2024-01-16", ordered=False)
    late = clean.scan_range(df, start="2024-01-16", ordered=False)
    flag = F.col("bitfield_gas_supplies_ok").cast("int").alias("gas_supplies_ok")
    return src.union_days([early.select(*LONG, flag), late.select(*LONG)])


_TIERS = ", ".join(f"({v[0]}, {v[3]})" for v in fixed.VARIABLES)
_WORDS = ", ".join(f"({i}, 0)" for i in fixed.STATUS_IDS)


@query(
    "variable_sets",
    sql(f"""SELECT s.variable_id, s.tier, s.tier IN (1, 2) AS is_feature, count(t.variable_id) AS n_rows
        FROM (VALUES {_TIERS}, {_WORDS}) s(variable_id, tier) LEFT JOIN telemetry t USING (variable_id)
        GROUP BY ALL"""),
)
def variable_sets(spark, sf):
    tiers = dims.variables(spark).select(F.col("id").alias("variable_id"), "tier")
    words = dims.status_bits(spark).select("variable_id", F.lit(0).alias("tier"))
    every = tiers.union(words).distinct()
    seen = ad.telemetry(spark, sf, status=False).groupBy("variable_id").agg(
        F.count(F.lit(1)).alias("n_rows")
    )
    return every.join(seen, "variable_id", "left").select(
        "variable_id", "tier", F.col("tier").isin(1, 2).alias("is_feature"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


_NAMES = ", ".join(f"('var_{v[0]}', '{v[1]}')" for v in fixed.VARIABLES)


@query(
    "feature_names",
    sql(f"""SELECT feature, coalesce(n.name, CASE WHEN feature LIKE 'bitfield_%'
          THEN replace(replace(feature, 'bitfield_', ''), '_', ' ') END, feature) AS human_name, n_rows
        FROM (SELECT 'var_' || variable_id AS feature, count(*) AS n_rows FROM telemetry GROUP BY 1
          UNION ALL SELECT 'bitfield_' || lower(p_type) || '_' || p_size, count(*) FROM part GROUP BY 1) f
        LEFT JOIN (VALUES {_NAMES}) n(feature, name) USING (feature)"""),
)
def feature_names(spark, sf):
    ids = ad.telemetry(spark, sf, status=False).select(
        F.concat(F.lit("var_"), F.col("variable_id").cast("string")).alias("feature")
    )
    parts = ad.table(spark, sf, "part").select(
        F.concat(F.lit("bitfield_"), F.lower("p_type"), F.lit("_"), F.col("p_size").cast("string")).alias("feature")
    )
    seen = ids.union(parts).groupBy("feature").agg(F.count(F.lit(1)).alias("n_rows"))
    return seen.withColumn("human_name", human_name(F.col("feature")))

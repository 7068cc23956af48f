"""Queries over the state tables and the feedback loop."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsegrid.operators import alerts as al
from pulsegrid.operators import feedback as fb
from pulsegrid.operators import state
from pulsegrid.session import materialize, scratch_path
from pulsegrid.sources import tables
from pulsegrid.workloads import adapter as ad
from pulsegrid.workloads import alert_queries as alq
from pulsegrid.workloads.registry import query
from pulsegrid.workloads.views_sql import r6, sql

NOW = dt.datetime(2001, 8, 2)
NOW_SQL = "TIMESTAMP '2001-08-02'"
_A = "id, device_serial, timestamp, alert_level, anomaly_score, fleet_percentile, notified, notified_at"


@query(
    "alerts_query",
    sql(f"""SELECT {_A} FROM alert_history WHERE timestamp >= TIMESTAMP '1997-01-01' AND timestamp < TIMESTAMP '1999-01-01'
        AND alert_level IN ('warning', 'critical') AND notified ORDER BY timestamp DESC, id DESC LIMIT 100"""),
    exact=True,
)
def alerts_query(spark, sf):
    return state.query_alerts(
        ad.alert_history(spark, sf), from_date="1997-01-01", to_date="1998-12-31",
        min_level="warning", notified_only=True, limit=100,
    )


@query("alerts_unnotified", sql(f"SELECT {_A} FROM alert_history WHERE NOT notified"), exact=True)
def alerts_unnotified(spark, sf):
    return state.unnotified(ad.alert_history(spark, sf))


@query(
    "latest_status",
    sql(f"SELECT {_A} FROM (SELECT *, rank() OVER (PARTITION BY device_serial ORDER BY timestamp DESC) AS r FROM alert_history) WHERE r = 1"),
    exact=True,
)
def latest_status(spark, sf):
    return state.latest_status(ad.alert_history(spark, sf))


@query(
    "score_history",
    sql(f"SELECT device_serial, timestamp, anomaly_score, fleet_percentile FROM alert_history WHERE timestamp >= {NOW_SQL} - INTERVAL 365 DAY"),
    exact=True,
)
def score_history(spark, sf):
    return state.score_history(ad.alert_history(spark, sf), NOW, 365)


_H = "id, timestamp, job_name, status, duration_ms, rows_processed, error_message"


@query(
    "health_query",
    sql(f"SELECT {_H} FROM health WHERE job_name = 'daily_inference' AND status = 'failure' ORDER BY timestamp DESC, id DESC LIMIT 10"),
)
def health_query(spark, sf):
    return state.query_health(ad.health(spark, sf), "daily_inference", "failure", limit=10)


@query(
    "error_notices",
    sql("""SELECT job_name, timestamp, 'PdM Service Error — ' || job_name AS subject,
        'Job: ' || job_name || chr(10) || 'Time: ' || strftime(timestamp, '%Y-%m-%dT%H:%M:%S') || chr(10)
        || 'Error: ' || coalesce(error_message, '') || chr(10) AS body FROM health WHERE status = 'failure'"""),
)
def error_notices(spark, sf):
    return al.error_notice(ad.health(spark, sf))


@query("work_orders_query", sql("SELECT * FROM work_orders WHERE NOT matched"), dates=("registered_date", "completed_date"))
def work_orders_query(spark, sf):
    return state.query_work_orders(ad.work_orders(spark, sf), unmatched_only=True)


@query(
    "labels_query",
    sql("SELECT device_serial, date, event_type, work_order_id AS cmms_work_order, notes FROM labels_table"),
    dates=("date",),
)
def labels_query(spark, sf):
    return state.training_labels(ad.labels(spark, sf))


@query("model_versions_query", sql("SELECT * FROM models"))
def model_versions_query(spark, sf):
    return state.model_versions(ad.models(spark, sf))


@query("active_model", sql("SELECT * FROM models WHERE active"))
def active_model(spark, sf):
    return state.model_versions(ad.models(spark, sf), active_only=True)


_ORDER = """work_order_id, work_order_type, registered_date, completed_date, fault_description,
  technical_description, device_reg, serial_number"""


def _import(spark, sf):
    path = scratch_path(spark, "orders-csv")
    tables.export_csv(ad.raw_work_orders(spark, sf), path)
    return tables.read_work_orders(spark, path, ad.registry(spark, sf))


@query(
    "work_orders_import",
    sql(f"SELECT {_ORDER}, g.device_serial FROM raw_work_orders w LEFT JOIN registry g ON g.cmms_reg = w.device_reg"),
    dates=("registered_date", "completed_date"),
)
def work_orders_import(spark, sf):
    return _import(spark, sf)


@query("work_orders_normalize", sql(f"SELECT {_ORDER} FROM raw_work_orders"), dates=("registered_date", "completed_date"))
def work_orders_normalize(spark, sf):
    from pulsegrid.fixed import WORK_ORDER_HEADERS

    raw = ad.raw_work_orders(spark, sf)
    renamed = raw.select(*[F.col(f"`{h}`").alias(n) for h, n in WORK_ORDER_HEADERS.items()])
    return fb.normalize_work_orders(renamed)


@query(
    "classify_work_order",
    sql("""SELECT work_order_id, CASE work_order_type WHEN 'corrective' THEN 'confirmed_fault'
        WHEN 'preventive' THEN 'scheduled_pv' ELSE 'unrelated' END AS event_type FROM work_orders"""),
)
def classify_work_order(spark, sf):
    return ad.work_orders(spark, sf).select(
        "work_order_id", fb.classify(F.col("work_order_type")).alias("event_type")
    )


def _matches(spark, sf):
    return fb.match_work_orders(
        ad.work_orders(spark, sf), ad.alert_history(spark, sf), ad.registry(spark, sf)
    )


@query("match_work_orders", sql("SELECT * FROM linked"), dates=("date",))
def match_work_orders(spark, sf):
    return _matches(spark, sf)


@query(
    "work_orders_upsert",
    sql(f"""SELECT {_ORDER} FROM (SELECT *, row_number() OVER (PARTITION BY work_order_id ORDER BY work_order_type,
          registered_date, completed_date NULLS FIRST, fault_description, technical_description, device_reg, serial_number) AS r
        FROM raw_work_orders) WHERE r = 1 AND work_order_id NOT IN (SELECT l_orderkey || '-1' FROM lineitem)"""),
    dates=("registered_date", "completed_date"),
)
def work_orders_upsert(spark, sf):
    stored = ad.table(spark, sf, "lineitem").select(
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-1")).alias("work_order_id")
    )
    return state.new_work_orders(work_orders_normalize(spark, sf), stored)


@query(
    "mark_matched",
    sql("SELECT w.* REPLACE (w.matched OR w.work_order_id IN (SELECT work_order_id FROM linked) AS matched) FROM work_orders w"),
    dates=("registered_date", "completed_date"),
)
def mark_matched(spark, sf):
    return state.mark_matched(ad.work_orders(spark, sf), _matches(spark, sf))


@query(
    "labels_append",
    sql(f"""SELECT device_serial, date, event_type, work_order_id, matched_alert_id, '' AS notes,
        {NOW_SQL} AS created_at, 'auto' AS source FROM linked"""),
    dates=("date",),
)
def labels_append(spark, sf):
    path = scratch_path(spark, "labels")
    tables.append_rows(state.label_rows(_matches(spark, sf), NOW), path)
    return spark.read.parquet(path).drop("id")


@query(
    "alerts_append",
    sql(f"""SELECT device_serial, TIMESTAMP '2024-02-01' AS timestamp, alert_level, {r6('anomaly_score', 'fleet_percentile')},
        false AS notified, CAST(NULL AS TIMESTAMP) AS notified_at FROM summary"""),
)
def alerts_append(spark, sf):
    path = scratch_path(spark, "history")
    rows = state.alert_rows(alq.run_summary(spark, sf), dt.datetime(2024, 2, 1))
    tables.append_rows(rows, path)
    return spark.read.parquet(path).drop("id")


_SENT = "SELECT device_serial, max(timestamp) AS timestamp FROM alert_history GROUP BY 1"


@query(
    "mark_notified",
    sql(f"""SELECT a.id, a.device_serial, a.timestamp, a.alert_level, a.anomaly_score, a.fleet_percentile,
        a.notified OR s.timestamp IS NOT NULL AS notified,
        CASE WHEN s.timestamp IS NOT NULL THEN {NOW_SQL} ELSE a.notified_at END AS notified_at
        FROM alert_history a LEFT JOIN ({_SENT}) s ON s.device_serial = a.device_serial AND s.timestamp = a.timestamp"""),
    exact=True,
)
def mark_notified(spark, sf):
    history = ad.alert_history(spark, sf)
    sent = state.latest_status(history)
    path = tables.new_version(state.mark_notified(history, sent, NOW), "alerts-v2")
    return spark.read.parquet(path)


@query(
    "health_append",
    sql(f"""SELECT {NOW_SQL} AS timestamp, 'daily_inference' AS job_name, 'success' AS status,
        CAST(45000 AS BIGINT) AS duration_ms, count(*) AS rows_processed, CAST(NULL AS VARCHAR) AS error_message FROM telemetry"""),
)
def health_append(spark, sf):
    rows = ad.telemetry(spark, sf, status=False)
    path = scratch_path(spark, "health")
    tables.append_rows(state.health_row(rows, NOW, "daily_inference", "success", 45_000), path)
    return spark.read.parquet(path)


@query(
    "model_register",
    sql(f"""SELECT version_id, trained_at, label_count, confirmed_count, model_path, performance_snapshot, false AS active FROM models
        UNION ALL SELECT 1000000 + count(*), {NOW_SQL}, CAST(count(*) AS INTEGER),
          CAST(count(*) FILTER (event_type = 'confirmed_fault') AS INTEGER), 'models/next', NULL, true FROM labels_table"""),
)
def model_register(spark, sf):
    fault = F.count_if(F.col("event_type") == "confirmed_fault")
    new = ad.labels(spark, sf).agg(
        (F.lit(1_000_000) + F.count(F.lit(1))).alias("version_id"),
        F.count(F.lit(1)).cast("int").alias("label_count"),
        fault.cast("int").alias("confirmed_count"),
    ).withColumns(
        {
            "trained_at": F.lit(NOW),
            "model_path": F.lit("models/next"),
            "performance_snapshot": F.lit(None).cast("string"),
        }
    )
    return state.register_model(ad.models(spark, sf), new)


_C = "id, device_serial, computed_at, window_start, window_end, result_json"


@query(
    "xai_cache_latest",
    sql(f"SELECT {_C} FROM (SELECT *, row_number() OVER (PARTITION BY device_serial ORDER BY computed_at DESC, id DESC) AS r FROM attribution_cache) WHERE r = 1"),
)
def xai_cache_latest(spark, sf):
    return state.latest_attribution(ad.attribution_cache(spark, sf))


@query(
    "xai_cache_todo",
    sql("SELECT device_serial FROM registry WHERE device_serial NOT IN (SELECT device_serial FROM attribution_cache WHERE computed_at >= TIMESTAMP '2024-01-30 12:00:00')"),
)
def xai_cache_todo(spark, sf):
    fresh = ad.attribution_cache(spark, sf).where("computed_at >= timestamp'2024-01-30 12:00:00'")
    return state.attribution_todo(ad.registry(spark, sf), fresh)


@query(
    "xai_cache_append",
    sql(f"""SELECT device_serial, {NOW_SQL} AS computed_at, min(window_start) AS window_start,
        max(window_end) AS window_end, '{{"n":' || count(*) || '}}' AS result_json FROM attribution_cache GROUP BY 1"""),
)
def xai_cache_append(spark, sf):
    result = ad.attribution_cache(spark, sf).groupBy("device_serial").agg(
        F.min("window_start").alias("window_start"),
        F.max("window_end").alias("window_end"),
        F.to_json(F.struct(F.count(F.lit(1)).alias("n"))).alias("result_json"),
    )
    path = scratch_path(spark, "attribution-cache")
    tables.append_rows(state.attribution_rows(result, NOW), path)
    return spark.read.parquet(path).drop("id")


_FAULTS = "count(*) FILTER (event_type = 'confirmed_fault')"


@query(
    "learning_summary",
    sql(f"SELECT count(*) AS total_labels, {_FAULTS} AS confirmed_count, count(*) >= 10 AND {_FAULTS} >= 1 AS retrain_ready FROM labels_table"),
)
def learning_summary(spark, sf):
    return fb.learning_summary(ad.labels(spark, sf))


@query(
    "reports_summary",
    sql(f"""SELECT count(*) AS total_alerts, count(*) FILTER (alert_level <> 'normal') AS warning_plus,
        (SELECT count(*) FROM labels_table) AS total_labels, (SELECT {_FAULTS} FROM labels_table) AS confirmed_count
        FROM alert_history"""),
)
def reports_summary(spark, sf):
    return fb.reports_summary(ad.alert_history(spark, sf), ad.labels(spark, sf))


_LAST = lambda job: f"(SELECT arg_max(status, timestamp) FROM health WHERE job_name = '{job}')"


@query(
    "pipeline_status",
    sql(f"""SELECT CASE WHEN {_LAST('daily_inference')} IS NULL THEN 'yellow' WHEN {_LAST('daily_inference')} = 'failure' THEN 'red'
        WHEN {_LAST('health_check')} = 'failure' THEN 'yellow' ELSE 'green' END AS status"""),
)
def pipeline_status(spark, sf):
    return fb.pipeline_status(ad.health(spark, sf))


@query(
    "export_alerts",
    sql("""SELECT CAST(id AS VARCHAR) AS id, device_serial, alert_level, CAST(notified AS VARCHAR) AS notified,
        strftime(timestamp, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(anomaly_score AS VARCHAR) AS anomaly_score
        FROM (SELECT * FROM alert_history)"""),
)
def export_alerts(spark, sf):
    """All alerts as headed CSV, read back as text."""
    rows = ad.alert_history(spark, sf).select(
        "id", "device_serial", "alert_level", "notified",
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), "anomaly_score",
    )
    path = scratch_path(spark, "alerts-csv")
    tables.export_csv(rows, path)
    return spark.read.csv(path, header=True)

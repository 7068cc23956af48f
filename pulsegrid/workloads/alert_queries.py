"""Queries on scores, alerts and evaluation."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsegrid.operators import alerts as al
from pulsegrid.operators import evaluate as ev
from pulsegrid.operators import rank
from pulsegrid.session import materialize
from pulsegrid.workloads import adapter as ad
from pulsegrid.workloads import alignment_queries as aq
from pulsegrid.workloads.registry import query
from pulsegrid.workloads.views_sql import CTES, r6, sql, stats_sql

THRESHOLD, SUSTAINED, CRITICAL = 0.7, 3, 0.95
NOW = dt.datetime(1998, 6, 1)


def _ranked(spark, sf):
    return rank.fleet_percentile(materialize(ad.scores(spark, sf), "scores"))


def _stored(spark, sf):
    return materialize(_ranked(spark, sf), "ranked")


def _alerts(spark, sf, ranked=None):
    ranked = _stored(spark, sf) if ranked is None else ranked
    return al.sustained_alerts(
        ranked, ad.registry(spark, sf), THRESHOLD, SUSTAINED, CRITICAL, slice=ad.SLICE
    )


@query("fleet_percentile", sql(f"SELECT device_serial, window_start, window_end, timestamp, {r6('anomaly_score', 'fleet_percentile')} FROM ranked"))
def fleet_percentile(spark, sf):
    return _ranked(spark, sf)


@query(
    "threshold_runs",
    sql(f"SELECT device_serial, run_id, run_start, run_end, n_windows, {r6('max_score', 'max_percentile')} FROM run_groups"),
)
def threshold_runs(spark, sf):
    return rank.run_table(rank.threshold_runs(_stored(spark, sf), THRESHOLD, slice=ad.SLICE))


@query("alerts", sql("SELECT * FROM alert_rows"))
def alerts(spark, sf):
    return _alerts(spark, sf)


@query("alert_level_counts", sql("SELECT alert_level, count(*) AS n_alerts FROM alert_rows GROUP BY 1"))
def alert_level_counts(spark, sf):
    return al.level_counts(_alerts(spark, sf))


@query("run_summary", sql(f"SELECT device_serial, alert_level, {r6('anomaly_score', 'fleet_percentile')} FROM summary"))
def run_summary(spark, sf):
    ranked = _stored(spark, sf)
    return al.run_summary(ranked, _alerts(spark, sf, ranked))


_QUIET = """SELECT device_serial FROM (SELECT device_serial, arg_max(notified_at, {'t': timestamp, 'id': id}) AS last
  FROM alert_history WHERE notified AND alert_level <> 'normal' GROUP BY 1)
  WHERE last > TIMESTAMP '1998-06-01' - INTERVAL 2400 HOUR"""


@query(
    "alert_cooldown",
    sql(f"""SELECT device_serial, alert_level, anomaly_score, alert_start FROM alert_rows
        WHERE alert_level <> 'normal' AND device_serial NOT IN ({_QUIET})"""),
)
def alert_cooldown(spark, sf):
    kept = al.cooldown(_alerts(spark, sf), ad.alert_history(spark, sf), NOW, hours=2400)
    return kept.select("device_serial", "alert_level", "anomaly_score", "alert_start")


@query(
    "alert_digest",
    sql("""SELECT device_serial, alert_start AS timestamp,
        'PdM Alert — ' || (SELECT count(*) FROM alert_rows WHERE alert_level <> 'normal')
          || CASE WHEN (SELECT count(*) FROM alert_rows WHERE alert_level <> 'normal') = 1 THEN ' device' ELSE ' devices' END
          || ' requires attention' AS subject,
        'Device ' || coalesce(CAST(cmms_reg AS VARCHAR), '?') || ' — ' || upper(alert_level)
          || ' (fleet percentile: ' || CAST(CAST(round_even(fleet_percentile * 100, 0) AS INTEGER) AS VARCHAR) || '%)' || chr(10)
          || '  Since: ' || strftime(alert_start, '%Y-%m-%d %H:%M:%S') || chr(10)
          || '  Top drivers: ' || top_contributing_features || chr(10)
          || '  Details: http://localhost:8000/device/' || device_serial || chr(10) AS block
        FROM alert_rows WHERE alert_level <> 'normal'"""),
)
def alert_digest(spark, sf):
    rows = materialize(_alerts(spark, sf).where("alert_level <> 'normal'"), "actionable")
    return al.digest(rows)


@query("fleet_status", sql("""
SELECT device_serial, round(fleet_percentile + 1e-10, 6) + 0.0 AS fleet_percentile, CASE WHEN fleet_percentile * 100 >= 99 THEN 'critical'
  WHEN fleet_percentile * 100 >= 95 THEN 'warning' ELSE 'normal' END AS band FROM summary"""))
def fleet_status(spark, sf):
    ranked = _stored(spark, sf)
    return al.fleet_status(al.run_summary(ranked, _alerts(spark, sf, ranked)))


@query(
    "event_windows",
    sql(f"""SELECT event_id, cmms_reg, event_date, description, device_serial, timestamp,
        {r6('anomaly_score', 'fleet_percentile', 'days_to_event')} FROM near"""),
    dates=("event_date",),
)
def event_windows(spark, sf):
    near = ev.event_windows(_ranked(spark, sf), ad.failures(spark, sf))
    return near.drop("window_start", "window_end")


@query("lead_time", sql(f"SELECT event_id, {r6('lead_time_days')} FROM lead"))
def lead_time(spark, sf):
    near = materialize(ev.event_windows(_ranked(spark, sf), ad.failures(spark, sf)), "near")
    return ev.lead_time(near, THRESHOLD, SUSTAINED)


def _evaluated(spark, sf, name="mean-reading", threshold=THRESHOLD):
    return ev.evaluate_model(
        _stored(spark, sf), ad.failures(spark, sf), name, threshold, SUSTAINED
    )


@query(
    "evaluate_model",
    sql(f"""SELECT model, event_id, cmms_reg, event_date, description, detected,
        {r6('lead_time_days', 'max_percentile_pre')}, n_score_points FROM evaluated"""),
    dates=("event_date",),
)
def evaluate_model(spark, sf):
    return _evaluated(spark, sf)


def _again(text: str, tag: str) -> str:
    """Second evaluation with a lower threshold, as its own set of views."""
    for name in ("pre_runs", "lead", "evaluated"):
        text = text.replace(f"FROM {name}", f"FROM {name}{tag}").replace(f"JOIN {name} ", f"JOIN {name}{tag} ")
    return text.replace("0.7", "0.5").replace("mean-reading", "mean-reading-low")


@query(
    "model_comparison",
    sql(
        f"""SELECT model, count(*) FILTER (detected) || '/' || count(*) AS events_detected,
        round(avg(lead_time_days) + 1e-10, 6) + 0.0 AS mean_lead_time
        FROM (SELECT * FROM evaluated UNION ALL SELECT * FROM evaluated_b) GROUP BY 1""",
        {f"{n}_b": _again(CTES[n], "_b") for n in ("pre_runs", "lead", "evaluated")},
    ),
)
def model_comparison(spark, sf):
    ranked, failures = _stored(spark, sf), ad.failures(spark, sf)
    return ev.model_comparison(
        [
            ev.evaluate_model(ranked, failures, "mean-reading", THRESHOLD, SUSTAINED),
            ev.evaluate_model(ranked, failures, "mean-reading-low", 0.5, SUSTAINED),
        ]
    )


@query(
    "detection_summary",
    sql("""SELECT model, count(*) FILTER (detected) AS n_detected, count(*) AS n_events,
        round(coalesce(avg(lead_time_days), 0) + 1e-10, 6) + 0.0 AS mean_lead_time FROM evaluated GROUP BY 1"""),
)
def detection_summary(spark, sf):
    return ev.detection_summary(_evaluated(spark, sf))


@query(
    "pv_eval",
    sql("""SELECT event_id, cmms_reg, pv_date, round(m + 1e-10, 6) + 0.0 AS mean_score_pre,
          round(z + 1e-10, 6) + 0.0 AS zscore_vs_fleet, CAST(z > 2.0 AS INTEGER) AS elevated, n_points
        FROM (SELECT v.event_id, v.cmms_reg, v.event_date AS pv_date, avg(s.anomaly_score) AS m,
            CASE WHEN count(s.timestamp) > 0 THEN CASE WHEN (SELECT stddev_samp(anomaly_score) FROM scores) > 0
              THEN (avg(s.anomaly_score) - (SELECT avg(anomaly_score) FROM scores))
                / (SELECT stddev_samp(anomaly_score) FROM scores) ELSE 0 END END AS z,
            count(s.timestamp) AS n_points
          FROM services v LEFT JOIN scores s ON s.device_serial = v.device_serial
            AND s.timestamp >= v.event_date - INTERVAL 7 DAY AND s.timestamp < v.event_date
          GROUP BY 1, 2, 3)"""),
    dates=("pv_date",),
)
def pv_eval(spark, sf):
    rows = ev.service_control(materialize(ad.scores(spark, sf), "scores"), ad.services(spark, sf))
    return rows.withColumn("elevated", F.col("elevated").cast("int"))


def windows_to_alerts(spark, sf):
    """The whole chain on one model: telemetry to windows to scores to ranks to alerts."""
    scored = aq.linear_scores(spark, sf)
    scores = materialize(
        scored.select(
            "device_serial", "window_start", "window_end", F.col("window_end").alias("timestamp"),
            F.round("anomaly_score", 6).alias("anomaly_score"),
        ),
        "window-scores",
    )
    ranked = materialize(rank.fleet_percentile(scores), "window-ranks")
    return _alerts(spark, sf, ranked)


@query(
    "daily_inference",
    sql(
        "SELECT * FROM alert_rows",
        {
            **stats_sql(aq.NUMERIC),
            "scores": f"""SELECT device_serial, window_start, window_end, window_end AS timestamp,
                round({aq.OFFSET} - ({aq.LINEAR_SQL}), 6) AS anomaly_score FROM scaled""",
            **{n: CTES[n] for n in ("ranked", "run_rows", "run_groups", "alert_rows")},
        },
    ),
)
def daily_inference(spark, sf):
    return windows_to_alerts(spark, sf)

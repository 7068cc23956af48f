"""Queries over attribution tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.grid import bin_index, bin_start, seconds
from pulsegrid.operators import align
from pulsegrid.operators import attribution as at
from pulsegrid.operators import evaluate as ev
from pulsegrid.operators.rank import fleet_percentile
from pulsegrid.session import materialize
from pulsegrid.workloads import adapter as ad
from pulsegrid.workloads.registry import query
from pulsegrid.workloads.views_sql import BIN_US, IDS, r6, sql

STEP = seconds(ad.FREQ)
VARS = [f"var_{i}" for i in IDS]


def attribution(spark, sf):
    """Deterministic attribution near each failure: distance of each mean reading from 50."""
    ranked = fleet_percentile(materialize(ad.scores(spark, sf), "scores"))
    failures = ad.failures(spark, sf)
    near = materialize(
        ev.event_windows(ranked, failures).select(
            "event_id", "device_serial", "window_start", "anomaly_score"
        ),
        "near",
    )
    readings = align.resample_mean(ad.telemetry(spark, sf, status=False), ad.FREQ).select(
        "device_serial",
        bin_start(F.col("bin"), STEP).alias("window_start"),
        F.concat(F.lit("var_"), F.col("variable_id").cast("string")).alias("feature_name"),
        F.abs(F.col("value") - 50).alias("attribution_value"),
    )
    return materialize(at.event_attribution(near, readings, failures), "attribution")


@query(
    "event_attribution",
    sql(f"""SELECT event_id, cmms_reg, window_start, feature_name, human_name,
        {r6('attribution_value', 'anomaly_score', 'days_to_failure')} FROM attribution"""),
)
def event_attribution(spark, sf):
    return attribution(spark, sf)


@query("attr_top", sql(f"SELECT event_id, feature_name, {r6('mean_attribution')}, CAST(rank AS INTEGER) AS rank FROM attr_ranked WHERE rank <= 10"))
def attr_top(spark, sf):
    return at.top_features(attribution(spark, sf))


@query("attr_top5", sql(f"SELECT event_id, feature_name, {r6('mean_attribution')}, CAST(rank AS INTEGER) AS rank FROM attr_ranked WHERE rank <= 3"))
def attr_top5(spark, sf):
    """The short cut of the report (three of the five features present here)."""
    return at.top_features(attribution(spark, sf), 3)


@query(
    "attr_timeline",
    sql("""SELECT event_id, count(*) AS n_windows, round(avg(anomaly_score) + 1e-10, 6) + 0.0 AS mean_score,
        round(max(anomaly_score) + 1e-10, 6) + 0.0 AS max_score FROM timeline GROUP BY 1"""),
)
def attr_timeline(spark, sf):
    return at.timeline_summary(attribution(spark, sf))


_CELLS = ", ".join(
    f"round(coalesce(max(CASE WHEN feature_name = '{v}' THEN attribution_value END), 0) + 1e-10, 6) + 0.0 AS {v}" for v in VARS
)


@query(
    "attr_pivot",
    sql(f"""SELECT a.event_id, a.window_start, {_CELLS} FROM attribution a JOIN
        (SELECT event_id, feature_name FROM attr_ranked WHERE rank <= 3) USING (event_id, feature_name) GROUP BY 1, 2"""),
)
def attr_pivot(spark, sf):
    return at.attribution_pivot(attribution(spark, sf), VARS, 3)


@query(
    "attr_global",
    sql("""SELECT feature_name, any_value(human_name) AS human_name, round(sum(mean_attribution) + 1e-10, 6) + 0.0 AS total_attribution
        FROM attr_mean JOIN (SELECT DISTINCT feature_name, human_name FROM attribution) USING (feature_name)
        GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 20"""),
)
def attr_global(spark, sf):
    return at.global_importance(attribution(spark, sf))


@query(
    "xai_summary",
    sql("""SELECT r.event_id, f.cmms_reg, f.event_date AS failure_date, f.description, t.n_windows,
        CAST(round(CAST(t.m AS DECIMAL(18, 10)), 4) AS DOUBLE) AS mean_anomaly_score, round(t.x, 4) AS max_anomaly_score, CAST(r.rank AS INTEGER) AS feature_rank,
        r.feature_name, h.human_name, CAST(round(CAST(r.mean_attribution AS DECIMAL(18, 10)), 6) AS DOUBLE) AS mean_attribution
        FROM attr_ranked r JOIN failures f USING (event_id)
        JOIN (SELECT DISTINCT feature_name, human_name FROM attribution) h USING (feature_name)
        JOIN (SELECT event_id, count(*) AS n_windows, avg(anomaly_score) AS m, max(anomaly_score) AS x FROM timeline GROUP BY 1) t
        USING (event_id) WHERE r.rank <= 10"""),
    dates=("failure_date",),
)
def xai_summary(spark, sf):
    return at.report(attribution(spark, sf), ad.failures(spark, sf))


_SIGNED = f"""SELECT device_serial, make_timestamp((epoch_us(timestamp) // {BIN_US}) * {BIN_US}) AS window_start,
  variable_id, avg(value) - 50 AS mean, min(value) - 50 AS min, max(value) - 50 AS max FROM telemetry GROUP BY 1, 2, 3"""
_LONG = " UNION ALL ".join(
    f"SELECT device_serial, window_start, 'var_' || variable_id AS feature_name, {s} AS shap FROM signed"
    for s in ("mean", "min", "max")
)
_ROLLED = {
    "signed": _SIGNED,
    "shap_long": _LONG,
    "rolled": "SELECT device_serial, window_start, feature_name, sum(abs(shap)) AS attribution_value FROM shap_long GROUP BY 1, 2, 3",
}


def _signed(spark, sf):
    """Signed values per (window, summary feature), three statistics per variable."""
    rows = ad.telemetry(spark, sf, status=False).groupBy(
        "device_serial", bin_index(F.col("timestamp"), STEP).alias("bin"), "variable_id"
    ).agg(*[f("value").alias(n) for n, f in (("mean", F.avg), ("min", F.min), ("max", F.max))])
    name = lambda s: F.concat(F.lit("var_"), F.col("variable_id").cast("string"), F.lit(f"__{s}"))
    parts = F.array(
        *[F.struct(name(s).alias("f"), (F.col(s) - 50).alias("v")) for s in ("mean", "min", "max")]
    )
    return rows.select(
        "device_serial", bin_start(F.col("bin"), STEP).alias("window_start"), F.explode(parts).alias("p")
    ).select(
        "device_serial", "window_start", F.col("p.f").alias("summary_feature"), F.col("p.v").alias("shap")
    )


@query("attr_rollup", sql(f"SELECT device_serial, window_start, feature_name, {r6('attribution_value')} FROM rolled", _ROLLED))
def attr_rollup(spark, sf):
    return at.roll_up(_signed(spark, sf))


@query(
    "attr_rank",
    sql(
        """SELECT feature_name, human_name, round(m + 1e-10, 6) + 0.0 AS mean_abs_shap,
        CAST(row_number() OVER (ORDER BY m DESC, feature_name) AS INTEGER) AS rank
        FROM (SELECT feature_name, avg(attribution_value) AS m FROM rolled GROUP BY 1)
        JOIN (SELECT DISTINCT feature_name, human_name FROM attribution) USING (feature_name)""",
        _ROLLED,
    ),
)
def attr_rank(spark, sf):
    return at.importance(at.roll_up(_signed(spark, sf)))

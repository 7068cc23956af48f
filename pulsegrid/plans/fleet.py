"""Jobs over the whole fleet: training, scoring, daily inference, label matching, attribution."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from pulsegrid.models.forest import IsolationForest
from pulsegrid.models.store import ForestArtefact
from pulsegrid.operators import alerts as al
from pulsegrid.operators import attribution as at
from pulsegrid.operators import evaluate, feedback, state
from pulsegrid.operators.rank import fleet_percentile
from pulsegrid.operators.scaling import Scaler, impute, medians
from pulsegrid.operators.windows import summary_columns
from pulsegrid.plans.features import FeaturePlan
from pulsegrid.session import materialize


def train(
    long: DataFrame, plan: FeaturePlan, trees: int = 200, contamination: float = 0.01, seed: int = 42
) -> ForestArtefact:
    """Fit scaler and forest on all windows of the fleet."""
    stats, features = plan.summaries(long)
    columns = summary_columns(features)
    stats = materialize(stats, "train-windows")
    filled = impute(stats, medians(stats, columns))
    scaler = Scaler.fit(filled, columns)
    vectors = materialize(
        scaler.vector(filled).select("device_serial", "window_start", "x"), "train-vectors"
    )
    forest = IsolationForest.fit(vectors, trees, contamination, seed)
    return ForestArtefact(forest, scaler, features)


def model_vectors(
    stats: DataFrame, model: ForestArtefact, stored: dict[str, float | None] | None = None
) -> DataFrame:
    """Imputed (by the batch's medians, or ``stored`` ones) and scaled window vectors."""
    columns = summary_columns(model.features)
    fill = medians(stats, columns) if stored is None else stored
    return model.scaler.vector(impute(stats, fill))


def score_batch(long: DataFrame, model: ForestArtefact, plan: FeaturePlan) -> DataFrame:
    """Telemetry to scored windows with fleet percentiles (an empty input gives no rows)."""
    stats = materialize(plan.summaries(long)[0], "batch-windows")
    scored = model.forest.score(model_vectors(stats, model)).withColumn(
        "timestamp", F.col("window_end")
    )
    scores = materialize(
        scored.select("device_serial", "window_start", "window_end", "timestamp", "anomaly_score"),
        "batch-scores",
    )
    return fleet_percentile(scores)


def daily_inference(
    long: DataFrame,
    model: ForestArtefact,
    plan: FeaturePlan,
    registry: DataFrame,
    history: DataFrame,
    now: dt.datetime,
    threshold: float = 0.95,
    sustained: int = 3,
) -> dict[str, DataFrame]:
    """Score, alert, summarise: ``scores``, ``alerts``, rows for the alert ``history`` and the
    ``digest`` of devices outside their cooldown."""
    scores = materialize(score_batch(long, model, plan), "ranked-scores")
    alerts = materialize(
        al.sustained_alerts(scores, registry, threshold, sustained, features=model.features),
        "alerts",
    )
    return {
        "scores": scores,
        "alerts": alerts,
        "history": state.alert_rows(al.run_summary(scores, alerts), now),
        "digest": al.digest(al.cooldown(alerts, history, now)),
    }


def label_matching(
    orders: DataFrame, alerts: DataFrame, registry: DataFrame, labels: DataFrame, now: dt.datetime
) -> dict[str, DataFrame]:
    """New labels, the order table with matched rows marked, and the retrain condition."""
    matches = materialize(feedback.match_work_orders(orders, alerts, registry), "matches")
    fresh = state.label_rows(matches, now)
    every = labels.unionByName(fresh.select(*labels.columns))
    return {
        "labels": fresh,
        "orders": state.mark_matched(orders, matches),
        "summary": feedback.learning_summary(every),
    }


def retrain(
    long: DataFrame, plan: FeaturePlan, models: DataFrame, labels: DataFrame, path: str,
    now: dt.datetime, trees: int = 200,
) -> DataFrame:
    """Train on the whole fleet, store the artefact, return the model table with it active."""
    spark = long.sparkSession
    train(long, plan, trees).save(spark, path)
    fault = F.col("event_type") == "confirmed_fault"
    new = labels.agg(
        F.count(F.lit(1)).cast("int").alias("label_count"),
        F.count_if(fault).cast("int").alias("confirmed_count"),
    ).select(
        F.xxhash64(F.lit(path)).alias("version_id"),
        F.lit(now).alias("trained_at"),
        "label_count",
        "confirmed_count",
        F.lit(path).alias("model_path"),
        F.lit(None).cast("string").alias("performance_snapshot"),
    )
    return state.register_model(models, new)


def failure_attribution(
    stats: DataFrame, model: ForestArtefact, events: DataFrame,
    pre_days: int = 14, post_days: int = 2, method: str = "shap",
) -> DataFrame:
    """Attribution of the windows around every event, all events in one job.

    ``stats`` is a stored window table. Only windows near an event are explained."""
    if method != "shap":
        raise ValueError(f"no event attribution by {method!r}")
    near = evaluate.event_windows(
        stats.withColumn("timestamp", F.col("window_end")), events, pre_days, post_days
    ).select("event_id", "device_serial", "window_start")
    wanted = stats.join(
        near.select("device_serial", "window_start").distinct(),
        ["device_serial", "window_start"], "left_semi",
    )
    vectors = materialize(
        model_vectors(materialize(wanted, "event-windows"), model).select(
            "device_serial", "window_start", "x"
        ),
        "event-vectors",
    )
    scored = near.join(model.forest.score(vectors), ["device_serial", "window_start"])
    values = at.per_window(at.shap_values(model.forest, vectors), model.scaler.columns)
    return at.event_attribution(scored, values, events)

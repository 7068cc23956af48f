"""Queries that fit models on the given telemetry; their results depend on seeded sampling, so
they have no SQL text and are held to properties by the tests."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pulsegrid.models.forest import IsolationForest
from pulsegrid.models.linear_svm import LinearOneClass
from pulsegrid.models.reconstruction import Reconstruction
from pulsegrid.models.store import ForestArtefact
from pulsegrid.operators import attribution as at
from pulsegrid.operators import scaling, windows
from pulsegrid.plans import fleet
from pulsegrid.session import materialize, scratch_path
from pulsegrid.workloads import adapter as ad
from pulsegrid.workloads import alignment_queries as aq
from pulsegrid.workloads.registry import query

TREES = 200
NUMERIC, COLUMNS = ad.NUMERIC, aq.COLUMNS
NOW = dt.datetime(2024, 2, 1)


def _plan():
    return aq._plan([], NUMERIC)


def _vectors(spark, sf):
    stats = aq.summaries(spark, sf)
    filled = scaling.impute(stats, scaling.medians(stats, COLUMNS))
    vectors = scaling.Scaler.fit(filled, COLUMNS).vector(filled)
    return materialize(vectors, "vectors")


@query("iforest_fit")
def iforest_fit(spark, sf):
    return IsolationForest.fit(_vectors(spark, sf), TREES).nodes


@query("iforest_score")
def iforest_score(spark, sf):
    vectors = _vectors(spark, sf)
    return IsolationForest.fit(vectors, TREES).score(vectors)


@query("iforest_predict")
def iforest_predict(spark, sf):
    vectors = _vectors(spark, sf)
    return IsolationForest.fit(vectors, TREES).predict(vectors)


@query("ocsvm_fit")
def ocsvm_fit(spark, sf):
    vectors = _vectors(spark, sf)
    return LinearOneClass.fit(vectors).predict(vectors).drop("x")


def _tensors(spark, sf):
    tensor = windows.window_tensor(aq._members(spark, sf), NUMERIC)
    return materialize(tensor, "tensors")


@query("recon_score")
def recon_score(spark, sf):
    tensors = _tensors(spark, sf)
    return Reconstruction.fit(tensors, len(NUMERIC)).score(tensors)


def _errors(spark, sf):
    tensors = _tensors(spark, sf)
    scored = Reconstruction.fit(tensors, len(NUMERIC)).score_per_feature(tensors)
    names = F.array(*[F.lit(f) for f in NUMERIC])
    return scored.select(
        "device_serial", "window_start", F.explode(F.arrays_zip(names.alias("f"), F.col("errors").alias("e"))).alias("p")
    ).select("device_serial", "window_start", F.col("p.f").alias("feature_name"), F.col("p.e").alias("error"))


@query("recon_per_feature")
def recon_per_feature(spark, sf):
    return _errors(spark, sf)


@query("recon_attribution")
def recon_attribution(spark, sf):
    return at.importance(_errors(spark, sf), "error", "mean_reconstruction_error")


def _artefact(spark, sf):
    return fleet.train(ad.telemetry(spark, sf, status=False), _plan(), TREES)


@query("model_roundtrip")
def model_roundtrip(spark, sf):
    """Scores of a model that was stored and loaded again."""
    path = scratch_path(spark, "model")
    _artefact(spark, sf).save(spark, path)
    model = ForestArtefact.load(spark, path)
    return model.forest.score(fleet.model_vectors(aq.summaries(spark, sf), model))


@query("score_batch")
def score_batch(spark, sf):
    return fleet.score_batch(
        ad.telemetry(spark, sf, status=False), _artefact(spark, sf), _plan()
    )


@query("retrain")
def retrain(spark, sf):
    return fleet.retrain(
        ad.telemetry(spark, sf, status=False), _plan(), ad.models(spark, sf),
        ad.labels(spark, sf), scratch_path(spark, "retrained"), NOW, TREES,
    )


def _explained(spark, sf):
    vectors = _vectors(spark, sf).select("device_serial", "window_start", "x")
    forest = IsolationForest.fit(vectors, TREES)
    return at.per_window(at.shap_values(forest, vectors), COLUMNS)


@query("shap_per_window")
def shap_per_window(spark, sf):
    return _explained(spark, sf)


@query("shap_importance")
def shap_importance(spark, sf):
    return at.importance(_explained(spark, sf))


@query("failure_attribution")
def failure_attribution(spark, sf):
    model = fleet.train(ad.telemetry(spark, sf, status=False), _plan(), TREES)
    return fleet.failure_attribution(aq.summaries(spark, sf), model, ad.failures(spark, sf))

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.quantiles import exact_quantiles
from pulsegrid.models.forest import IsolationForest, flat_trees, path_lengths
from pulsegrid.models.linear_svm import LinearOneClass
from pulsegrid.models.reconstruction import Reconstruction
from pulsegrid.models.store import ForestArtefact
from pulsegrid.operators import attribution as at
from pulsegrid.operators.scaling import Scaler, impute, medians, standardize
from pulsegrid.session import scratch_path

START = dt.datetime(2025, 12, 1)


def vectors(spark, x):
    rows = [(f"d{i % 7}", START + dt.timedelta(minutes=i), [float(v) for v in r]) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "device_serial string, window_start timestamp, x array<double>")


@pytest.fixture(scope="module")
def planted(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(0, 1, (1500, 5))
    x[:20] += 6
    return x, vectors(spark, x).cache()


def test_forest_separates_planted_outliers(spark, planted):
    x, df = planted
    model = IsolationForest.fit(df, 40)
    scored = model.predict(df).toPandas().sort_values("window_start")
    s = scored["anomaly_score"].to_numpy()
    auc = (s[:20, None] > s[None, 20:]).mean()
    assert auc > 0.95
    assert (scored["prediction"] == -1).mean() == pytest.approx(0.01, abs=0.004)


def test_forest_does_not_depend_on_partitioning(spark, planted):
    _, df = planted
    key = ["tree", "node"]
    a = IsolationForest.fit(df.repartition(3), 5).nodes.orderBy(key).collect()
    b = IsolationForest.fit(df.repartition(7), 5).nodes.orderBy(key).collect()
    assert a == b
    roots = [r for r in a if r.node == 0]
    assert len(roots) == 5 and {r["size"] for r in roots} == {256}


def test_artefact_roundtrip(spark, planted):
    _, df = planted
    forest = IsolationForest.fit(df, 5)
    path = scratch_path(spark, "model")
    ForestArtefact(forest, Scaler(["a", "b"], [1.0, 2.0], [3.0, 1.0]), ["f"]).save(spark, path)
    loaded = ForestArtefact.load(spark, path)
    key = ["device_serial", "window_start"]
    assert loaded.forest.score(df).orderBy(key).collect() == forest.score(df).orderBy(key).collect()
    assert loaded.scaler == Scaler(["a", "b"], [1.0, 2.0], [3.0, 1.0]) and loaded.features == ["f"]


def test_shapley_values_add_up(spark, planted):
    x, df = planted
    model = IsolationForest.fit(df, 6)
    trees = flat_trees(model.nodes.toPandas())
    base, some = x[100:140], x[:30]
    values = at.shapley(trees, some, base)
    want = path_lengths(trees, some) - path_lengths(trees, base).mean()
    np.testing.assert_allclose(values.sum(axis=1), want, atol=1e-9)


def test_shapley_matches_enumeration(spark, planted):
    from itertools import permutations

    x, df = planted
    trees = flat_trees(IsolationForest.fit(df, 3).nodes.toPandas())
    row, base = x[3], x[200:204]
    want = np.zeros(5)
    orders = list(permutations(range(5)))
    for z in base:
        for order in orders:
            now, before = z.copy(), path_lengths(trees, z[None])[0]
            for f in order:
                now[f] = row[f]
                after = path_lengths(trees, now[None])[0]
                want[f] += after - before
                before = after
    np.testing.assert_allclose(at.shapley(trees, row[None], base)[0], want / (len(orders) * 4), atol=1e-9)


def test_per_window_sums_statistics(spark):
    df = spark.createDataFrame([("a", START, [1.0, -2.0, 0.5, -0.25])], "device_serial string, window_start timestamp, shap array<double>")
    got = at.per_window(df, ["f__mean", "g__mean", "f__std", "g__std"]).collect()
    assert {r.feature_name: r.attribution_value for r in got} == {"f": 1.5, "g": 2.25}


def test_svm_bounds_outliers(spark, planted):
    x, _ = planted
    df = vectors(spark, x[20:] + 3).cache()
    model = LinearOneClass.fit(df, nu=0.1, steps=60)
    share = model.predict(df).where("prediction = -1").count() / len(x[20:])
    assert share < 0.2
    far = vectors(spark, np.full((1, 5), -4.0))
    assert model.score(far).first().anomaly_score > 0
    small = LinearOneClass.fit(df, nu=0.1, steps=5, max_rows=100)
    assert len(small.weights) == 5


def test_subsample_is_the_rows_of_smallest_hash(spark, planted):
    from pyspark.sql import functions as F

    from pulsegrid.models import linear_svm
    from pulsegrid.models.forest import KEY

    _, df = planted
    draw = F.pmod(F.xxhash64(*KEY, F.lit(1)), F.lit(linear_svm._SPACE))
    got = linear_svm.subsample(df, 300, 1).select("window_start").collect()
    assert sorted(got) == sorted(df.orderBy(draw, *KEY).limit(300).select("window_start").collect())


def test_reconstruction_is_exact_at_full_rank(spark):
    rng = np.random.default_rng(1)
    flat = rng.normal(0, 1, (60, 6))
    rows = [("a", START + dt.timedelta(minutes=i), r.reshape(3, 2).tolist()) for i, r in enumerate(flat)]
    df = spark.createDataFrame(rows, "device_serial string, window_start timestamp, tensor array<array<double>>")
    exact = Reconstruction.fit(df, 2, k=6).score(df)
    assert exact.agg(F.max("anomaly_score")).first()[0] < 1e-12
    lossy = Reconstruction.fit(df, 2, k=2).score_per_feature(df).collect()
    assert all(len(r.errors) == 2 and min(r.errors) >= 0 for r in lossy)


@pytest.mark.parametrize("q", [0.0, 0.5, 0.73, 0.99, 1.0])
def test_quantiles_by_narrowing(spark, q):
    rng = np.random.default_rng(5)
    cols = {
        "normal": rng.normal(35, 0.01, 3000), "ties": rng.integers(0, 3, 3000).astype(float),
        "heavy": np.exp(rng.normal(0, 6, 3000)), "constant": np.full(3000, 2.5),
        "third": np.where(np.arange(3000) % 3 == 0, 1.0, rng.normal(0, 1, 3000)),
    }
    rows = [tuple(float(v[i]) if (i + j) % 11 else None for j, v in enumerate(cols.values())) + (None,) for i in range(3000)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in [*cols, "none"])).cache()
    names = [*cols, "none"]
    got = exact_quantiles(df, names, q, small=10)
    direct = exact_quantiles(df, names, q)
    for j, (c, v) in enumerate(cols.items()):
        known = [v[i] for i in range(3000) if (i + j) % 11]
        assert got[c] == pytest.approx(np.quantile(known, q), rel=1e-12)
        assert direct[c] == pytest.approx(got[c], rel=1e-12)
    assert got["none"] is None


def test_scaling(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (3.0, 5.0, None), (None, None, None)], "a double, b double, c double")
    filled = impute(df, medians(df, ["a", "b", "c"]))
    assert [r.a for r in filled.collect()] == [1.0, 3.0, 2.0]
    rows = standardize(filled, ["a", "b", "c"]).collect()
    assert [r.b for r in rows] == [0.0, 0.0, 0.0] and rows[2].a == 0.0
    assert rows[0].a == pytest.approx(-np.sqrt(1.5))
    vector = Scaler.fit(filled, ["a", "c"]).vector(filled).first()
    assert vector.x[1] == 0.0


def ragged(spark, padded: bool):
    """Windows of 4 and of 6 rows with two features, one empty and one longer than the rest."""
    rng = np.random.default_rng(3)
    tensors = [rng.normal(size=(6 if i % 3 else 4, 2)) for i in range(60)]
    pad = lambda x: x.tolist() + [[None, None]] * (6 - len(x) if padded else 0)
    rows = [(i, len(x), pad(x)) for i, x in enumerate(tensors)]
    return tensors, spark.createDataFrame(rows, "id int, n_samples int, tensor array<array<double>>")


@pytest.mark.parametrize("padded", [False, True])
def test_windows_of_two_lengths_fit_and_score(spark, padded):
    tensors, df = ragged(spark, padded)
    model = Reconstruction.fit(df, 2, k=3)
    flat = [x.reshape(-1) for x in tensors]
    mean = np.array([np.mean([v[j] for v in flat if len(v) > j]) for j in range(12)])
    assert model.mean == pytest.approx(mean)
    x = np.array([np.concatenate([v, mean[len(v):]]) for v in flat]) - mean
    pc = np.linalg.svd(x, full_matrices=False)[2][:3].T
    miss = (x - x @ pc @ pc.T) ** 2
    for r in model.score_per_feature(df).collect():
        n = len(flat[r["id"]])
        assert r["errors"] == pytest.approx(miss[r["id"], :n].reshape(-1, 2).mean(axis=0))
    scores = {r["id"]: r["anomaly_score"] for r in model.score(df).collect()}
    assert scores[0] == pytest.approx(miss[0, :8].mean())


def test_empty_and_longer_windows_have_a_defined_score(spark):
    _, df = ragged(spark, False)
    model = Reconstruction.fit(df, 2, k=3)
    one = df.where("id = 1").first()["tensor"]
    odd = spark.createDataFrame(
        [(0, []), (1, one), (2, one + one), (3, None), (4, [[None, None]] * 2)], "id int, tensor array<array<double>>"
    )
    scores = {r["id"]: r["anomaly_score"] for r in model.score(odd).collect()}
    assert scores[0] is None and scores[3] is None
    assert scores[2] == pytest.approx(scores[1]) and scores[4] > 0
    with pytest.raises(ValueError):
        Reconstruction.fit(odd.where("id = 0"), 2)


def grown(trees, sample=256, width=12, limit=8):
    from pulsegrid.models.forest import _grow, flat_trees

    import pandas as pd

    rng = np.random.default_rng(6)
    x = rng.normal(0, 1, (4000, width))
    names = ["tree", "node", "feature", "threshold", "left", "right", "size", "depth"]
    nodes = [(t, *n) for t in range(trees) for n in _grow(x[rng.choice(4000, sample, False)], rng, limit)]
    return flat_trees(pd.DataFrame(nodes, columns=names)), x


def test_explaining_rows_costs_lookups_not_the_background():
    import time

    trees, x = grown(40)
    base, parts = x[:500], at.prepared(trees, x[:500])
    before = time.process_time()
    values = at.shapley(trees, x, base, parts)
    assert time.process_time() - before < 1.5  # some 4 s where every leaf groups the rows of a batch
    want = path_lengths(trees, x) - path_lengths(trees, base).mean()
    np.testing.assert_allclose(values.sum(axis=1), want, atol=1e-9)


@pytest.mark.parametrize("bits", [0, 1, 3, 5])
def test_tables_and_patterns_explain_alike(monkeypatch, bits):
    trees, x = grown(4, width=6, limit=9)
    want = at.shapley(trees, x[:50], x[100:140])
    monkeypatch.setattr(at, "BITS", bits)
    np.testing.assert_allclose(at.shapley(trees, x[:50], x[100:140]), want, atol=1e-12)


def test_scoring_follows_each_tree_to_its_leaf():
    trees, x = grown(5)

    def depth(t, row):
        node = 0
        while t.feature[node] >= 0:
            node = (t.left if row[t.feature[node]] < t.threshold[node] else t.right)[node]
        return t.value[node]

    x[3, :] = np.nan
    want = [np.mean([depth(t, row) for t in trees]) for row in x[:40]]
    assert path_lengths(trees, x[:40]).tolist() == pytest.approx(want, rel=1e-12)


@pytest.mark.parametrize("values", [[-np.inf, 0.0, np.inf], [1.0, np.nextafter(1, 2)], [5e-324, 1e-323, -0.0], [-1.7e308, 0.0, 1.7e308]])
def test_quantiles_of_extreme_values(spark, values):
    known = [v for v in values for _ in range(40)]
    df = spark.createDataFrame([(float(v),) for v in known] + [(None,), (float("nan"),)], "a double").repartition(3)
    for q in (0.0, 0.2, 1.0):
        at_ = int(q * (len(known) - 1))
        got = exact_quantiles(df, ["a"], q, small=2)["a"]
        assert sorted(known)[at_] <= got <= sorted(known)[min(at_ + 1, len(known) - 1)]

"""Attribution of forest scores to features, its roll-ups and report tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from pulsegrid.functions.grid import at_midnight, days_between
from pulsegrid.functions.text import human_name
from pulsegrid.models.forest import KEY, FlatTree, IsolationForest, flat_trees
from pulsegrid.models.linear_svm import subsample


@dataclass
class _Table:
    """Part of a tree whose Shapley values are looked up: the bits of a row's code that its splits
    set, and one line of values per feature, by code."""

    splits: list[tuple[int, float, int]]  # feature, threshold, bit
    features: list[int]
    values: np.ndarray


@dataclass
class _Split:
    """A split above the tables; what it accepts is kept in one bit of the code per feature."""

    feature: int
    threshold: float
    bit: int
    again: bool
    left: "_Split | _Table | list"
    right: "_Split | _Table | list"


@cache
def _shares(n: int) -> np.ndarray:
    """Values of a leaf with ``n`` path features and unit mass: (background code, code * features)."""
    codes = np.arange(1 << n)
    bits = (codes[:, None] >> np.arange(n)) & 1 == 1
    z, x = bits[:, None, :], bits[None, :, :]
    for_x, for_z, dead = x & ~z, ~x & z, (~x & ~z).any(axis=2)
    a, b = for_x.sum(axis=2), for_z.sum(axis=2)
    plus, minus = np.where(dead, 0.0, _PLUS[a, b]), np.where(dead, 0.0, _MINUS[a, b])
    out = for_x * plus[:, :, None] - for_z * minus[:, :, None]
    return out.reshape(len(codes), len(codes) * n)


def _inner(tree: FlatTree, node: int) -> list[int]:
    """Splits of the subtree below ``node``."""
    todo, found = [node], []
    while todo:
        at = todo.pop()
        if tree.feature[at] >= 0:
            found.append(at)
            todo += [tree.right[at], tree.left[at]]
    return found


def _accepted(tree: FlatTree, node: int, known: dict, goes_left: dict):
    """For each leaf below ``node``: its value and, per path feature, whether it accepts, given that
    of the ``known`` path and of each split."""
    f = int(tree.feature[node])
    if f < 0:
        yield tree.value[node], known
        return
    here = goes_left[node]
    for side, on in ((tree.left[node], here), (tree.right[node], ~here)):
        yield from _accepted(tree, side, {**known, f: known[f] & on if f in known else on}, goes_left)


def _table(tree: FlatTree, node: int, slots: dict[int, int], code: np.ndarray, base: np.ndarray) -> _Table:
    """Values of the leaves below ``node``, summed, for every code of path features and splits;
    ``code`` is that of the path features of the background rows ``base``."""
    splits = _inner(tree, node)
    bit = {at: len(slots) + k for k, at in enumerate(splits)}
    placed = [(int(tree.feature[at]), tree.threshold[at], bit[at]) for at in splits]
    at_base = _coded(placed, code, base)
    codes = np.arange(1 << (len(slots) + len(splits)))
    is_on = lambda k: (codes >> k) & 1 == 1
    known = {f: is_on(k) for f, k in slots.items()}
    features = list(dict.fromkeys([*slots, *(f for f, _, _ in placed)]))
    values = np.zeros((len(features), len(codes)))
    for value, accepts in _accepted(tree, node, known, {at: is_on(k) for at, k in bit.items()}):
        own = np.zeros(len(codes), np.intp)
        for k, on in enumerate(accepts.values()):
            own |= on.astype(np.intp) << k
        mass = np.bincount(own[at_base], minlength=1 << len(accepts)) * value
        z = np.flatnonzero(mass)
        shares = (mass[z] @ _shares(len(accepts))[z]).reshape(-1, len(accepts))
        for k, f in enumerate(accepts):
            values[features.index(f)] += shares[own, k]
    return _Table(placed, features, values)


def _coded(splits: list[tuple[int, float, int]], code: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """``code`` with the bits of ``splits``; ``columns`` are (feature, row)."""
    out = code.astype(np.intp)
    for f, threshold, bit in splits:
        out |= (columns[f] < threshold).astype(np.intp) << bit
    return out


def _sides(split: _Split, code: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of both children of a split above the tables."""
    on = (columns[split.feature] < split.threshold).astype(code.dtype) << code.dtype.type(split.bit)
    one = code.dtype.type(1 << split.bit)
    if split.again:
        return code & (on | ~one), code & ~on
    return code | on, code | (on ^ one)


def _tabled(tree: FlatTree, node: int, slots: dict[int, int], code: np.ndarray, base: np.ndarray, box: dict):
    """A tree, or the part of it below ``node``, as splits and tables. Where a path has more features
    than a code has bits, its leaves stand as they are (see :func:`_by_pattern`)."""
    if len(slots) + len(_inner(tree, node)) <= BITS:
        return _table(tree, node, slots, code, base)
    f, cut = int(tree.feature[node]), tree.threshold[node]
    if f not in slots and len(slots) == BITS:
        return _patterns(tree, node, box, base)
    low, high = box.get(f, (-np.inf, np.inf))
    out = _Split(f, cut, slots.get(f, len(slots)), f in slots, [], [])
    slots = {**slots, f: out.bit}
    to_left, to_right = _sides(out, code, base)
    out.left = _tabled(tree, tree.left[node], slots, to_left, base, {**box, f: (low, min(high, cut))})
    out.right = _tabled(tree, tree.right[node], slots, to_right, base, {**box, f: (max(low, cut), high)})
    return out


def _patterns(tree: FlatTree, node: int, box: dict, base: np.ndarray) -> list[tuple]:
    """Leaves below ``node``: per distinct feature on the path the interval it accepts, and the
    acceptance patterns of the background rows with their mass."""
    out, stack = [], [(node, box)]
    while stack:
        node, box = stack.pop()
        f = int(tree.feature[node])
        if f >= 0:
            low, high = box.get(f, (-np.inf, np.inf))
            cut = tree.threshold[node]
            stack.append((tree.left[node], {**box, f: (low, min(high, cut))}))
            stack.append((tree.right[node], {**box, f: (max(low, cut), high)}))
            continue
        feats = list(box)
        low, high = (np.array([box[f][k] for f in feats])[:, None] for k in (0, 1))
        weight = 1 << np.arange(len(feats))
        z_codes, z_count = np.unique(weight @ ((base[feats] >= low) & (base[feats] < high)), return_counts=True)
        out.append((feats, low, high, weight, (z_codes[:, None] & weight) > 0, z_count * tree.value[node]))
    return out


def prepared(trees: list[FlatTree], background: np.ndarray) -> list:
    """What does not depend on the rows to explain: each tree as splits and tables."""
    base, none = np.ascontiguousarray(background.T), np.zeros(len(background), np.uint16)
    return [_tabled(t, 0, {}, none, base, {}) for t in trees]


def shapley(
    trees: list[FlatTree], x: np.ndarray, background: np.ndarray, parts: list | None = None
) -> np.ndarray:
    """Interventional Shapley values of the forest's mean path length.

    For a leaf, only which path features accept the row and the background row matters. Values are
    summed over the background once for every acceptance pattern, of several leaves together, and
    looked up by the rows. ``parts`` are those of :func:`prepared`, where many batches are explained."""
    columns = np.ascontiguousarray(x.T)
    out = np.zeros(columns.shape)
    for part in prepared(trees, background) if parts is None else parts:
        stack = [(part, np.zeros(len(x), np.uint16))]
        while stack:
            part, code = stack.pop()
            if isinstance(part, _Split):
                left, right = _sides(part, code, columns)
                stack += [(part.right, right), (part.left, left)]
            elif isinstance(part, _Table):
                at = _coded(part.splits, code, columns)
                for f, line in zip(part.features, part.values):
                    out[f] += line.take(at)
            else:
                _by_pattern(part, columns, out)
    return out.T / (len(background) * max(len(trees), 1))


def _by_pattern(leaves: list[tuple], columns: np.ndarray, out: np.ndarray) -> None:
    """Add the values of leaves whose paths have more features than a code has bits. Rows are grouped
    by what they are accepted by, so the cost per leaf follows the number of patterns."""
    for feats, low, high, weight, z_bits, mass in leaves:
        code_x = weight @ ((columns[feats] >= low) & (columns[feats] < high))
        x_codes, x_at = np.unique(code_x, return_inverse=True)
        x_bits = (x_codes[:, None] & weight) > 0
        for_x = x_bits[:, None, :] & ~z_bits[None, :, :]
        for_z = ~x_bits[:, None, :] & z_bits[None, :, :]
        dead = (~x_bits[:, None, :] & ~z_bits[None, :, :]).any(axis=2)
        a, b = for_x.sum(axis=2), for_z.sum(axis=2)
        share = np.where(dead, 0.0, mass[None, :])
        plus = _PLUS[a, b] * share
        minus = _MINUS[a, b] * share
        part = (for_x * plus[:, :, None] - for_z * minus[:, :, None]).sum(axis=1)
        out[feats] += part[x_at.ravel()].T


#: Bits of a code: a table has a line of 512 numbers per feature, some 50 MB for 200 trees.
BITS = 9
_DEEP = 70
_PLUS = np.zeros((_DEEP, _DEEP))
_MINUS = np.zeros((_DEEP, _DEEP))
for _a in range(_DEEP):
    for _b in range(_DEEP):
        if _a:
            _PLUS[_a, _b] = factorial(_a - 1) * factorial(_b) / factorial(_a + _b)
        if _b:
            _MINUS[_a, _b] = factorial(_a) * factorial(_b - 1) / factorial(_a + _b)


@dataclass
class _Explained:
    """A forest and its background rows; a worker prepares them once."""

    trees: list[FlatTree]
    background: np.ndarray

    @cached_property
    def parts(self) -> list:
        return prepared(self.trees, self.background)


def shap_values(
    model: IsolationForest, vectors: DataFrame, background: DataFrame | None = None,
    n_background: int = 500, seed: int = 42,
) -> DataFrame:
    """Add ``shap``: one signed value per entry of ``x``.

    The background is at most ``n_background`` rows, the forest a bounded node table."""
    spark = vectors.sparkSession
    chosen = subsample(vectors if background is None else background, n_background, seed)
    rows = np.vstack([r["x"] for r in chosen.select("x").collect()])
    shared = spark.sparkContext.broadcast(_Explained(flat_trees(model.nodes.toPandas()), rows))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        for pdf in batches:
            if len(pdf):
                x = np.vstack(pdf["x"].to_numpy()).astype(float)
                values = shapley(model.trees, x, model.background, model.parts)
                pdf = pdf.assign(shap=list(values))
            else:
                pdf = pdf.assign(shap=pd.Series(dtype=object))
            yield pdf.drop(columns="x")

    kept = [f for f in vectors.schema.fields if f.name != "x"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return vectors.mapInPandas(run, f"{schema}, shap ARRAY<DOUBLE>")


def per_window(shap: DataFrame, summary: list[str]) -> DataFrame:
    """Absolute values summed over the statistics of each raw feature, one row per feature."""
    raw = [c.rsplit("__", 1)[0] for c in summary]
    features = list(dict.fromkeys(raw))
    total = lambda f: sum(
        (F.abs(F.get("shap", F.lit(i))) for i, r in enumerate(raw) if r == f), F.lit(0.0)
    )
    pairs = [F.struct(F.lit(f).alias("feature_name"), total(f).alias("v")) for f in features]
    kept = [c for c in shap.columns if c != "shap"]
    return shap.select(*kept, F.explode(F.array(*pairs)).alias("p")).select(
        *kept,
        F.col("p.feature_name").alias("feature_name"),
        F.col("p.v").alias("attribution_value"),
    )


def roll_up(values: DataFrame, keys: list[str] = [*KEY]) -> DataFrame:
    """Long signed values ``(keys, summary_feature, shap)`` to absolute sums per raw feature."""
    raw = F.regexp_replace("summary_feature", "__[a-z]+$", "")
    return values.groupBy(*keys, raw.alias("feature_name")).agg(
        F.sum(F.abs("shap")).alias("attribution_value")
    )


def importance(per_window_values: DataFrame, value: str = "attribution_value",
               name: str = "mean_abs_shap") -> DataFrame:
    """Mean per feature with display name and rank (1 = highest).

    The ranking window sees one row per feature."""
    mean = per_window_values.groupBy("feature_name").agg(F.avg(value).alias(name))
    return mean.withColumns(
        {
            "human_name": human_name(F.col("feature_name")),
            "rank": F.row_number().over(W.orderBy(F.desc(name), "feature_name")),
        }
    )


def ranked(values: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rank 1..n by descending value inside each key (bounded: one row per feature)."""
    by = W.partitionBy(*keys).orderBy(F.desc(value), "feature_name")
    return values.withColumn("rank", F.row_number().over(by))


def event_attribution(
    scored_windows: DataFrame, per_window_values: DataFrame, events: DataFrame
) -> DataFrame:
    """Long attribution table of the windows near each event.

    Events with fewer than two windows are left out. ``scored_windows`` has the event id, the key
    columns and the score; ``per_window_values`` one row per window and feature."""
    enough = scored_windows.groupBy("event_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    at = at_midnight(F.col("event_date"))
    return (
        scored_windows.join(enough.select("event_id"), "event_id", "left_semi")
        .join(per_window_values, [*KEY])
        .join(events.select("event_id", "cmms_reg", "event_date"), "event_id")
        .select(
            "event_id",
            "cmms_reg",
            "window_start",
            "feature_name",
            human_name(F.col("feature_name")).alias("human_name"),
            "attribution_value",
            "anomaly_score",
            days_between(at, F.col("window_start")).alias("days_to_failure"),
        )
    )


def top_features(attribution: DataFrame, top_n: int = 10) -> DataFrame:
    """Highest mean attribution per event, with rank."""
    mean = attribution.groupBy("event_id", "feature_name").agg(
        F.avg("attribution_value").alias("mean_attribution")
    )
    return ranked(mean, ["event_id"], "mean_attribution").where(F.col("rank") <= top_n)


def score_timeline(attribution: DataFrame) -> DataFrame:
    """One score per event and window."""
    return attribution.groupBy("event_id", "window_start").agg(
        F.min("anomaly_score").alias("anomaly_score")
    )


def timeline_summary(attribution: DataFrame) -> DataFrame:
    return score_timeline(attribution).groupBy("event_id").agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.avg("anomaly_score").alias("mean_score"),
        F.max("anomaly_score").alias("max_score"),
    )


def attribution_pivot(attribution: DataFrame, features: list[str], top_n: int = 10) -> DataFrame:
    """Windows by features, restricted to each event's top features; what is missing is 0."""
    top = top_features(attribution, top_n).select("event_id", "feature_name")
    kept = attribution.join(top, ["event_id", "feature_name"], "left_semi")
    cell = lambda f: F.max(F.when(F.col("feature_name") == f, F.col("attribution_value")))
    return kept.groupBy("event_id", "window_start").agg(
        *[F.coalesce(cell(f), F.lit(0.0)).alias(f) for f in features]
    )


def global_importance(attribution: DataFrame, top_n: int = 10) -> DataFrame:
    """Sum over events of the mean attribution per feature, the highest ``2 * top_n``."""
    mean = attribution.groupBy("event_id", "feature_name").agg(
        F.avg("attribution_value").alias("mean_attribution")
    )
    total = mean.groupBy("feature_name").agg(F.sum("mean_attribution").alias("total_attribution"))
    return (
        total.withColumn("human_name", human_name(F.col("feature_name")))
        .orderBy(F.desc("total_attribution"), "feature_name")
        .limit(2 * top_n)
    )


def report(attribution: DataFrame, events: DataFrame, top_n: int = 10) -> DataFrame:
    """Summary table: top features per event with window counts and scores. Means lose the last bits
    of their sums before they are rounded."""
    return (
        top_features(attribution, top_n)
        .join(timeline_summary(attribution), "event_id")
        .join(events.select("event_id", "cmms_reg", "event_date", "description"), "event_id")
        .select(
            "event_id",
            "cmms_reg",
            F.col("event_date").alias("failure_date"),
            "description",
            "n_windows",
            F.round(F.round("mean_score", 10), 4).alias("mean_anomaly_score"),
            F.round("max_score", 4).alias("max_anomaly_score"),
            F.col("rank").alias("feature_rank"),
            "feature_name",
            human_name(F.col("feature_name")).alias("human_name"),
            F.round(F.round("mean_attribution", 10), 6).alias("mean_attribution"),
        )
    )

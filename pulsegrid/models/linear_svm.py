"""Linear one-class SVM by full-batch subgradient steps.

Objective: ``nu/2 |w|^2 + b nu + mean(max(0, 1 - (w.x + b)))``; the decision value is
``w.x - offset`` with ``offset = 1 - b``. Every step is one Spark job that sums partial
gradients per partition; only the weight vector moves between driver and tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pulsegrid.functions.quantiles import exact_quantiles
from pulsegrid.models.forest import KEY


_SPACE = 1 << 50


def subsample(vectors: DataFrame, rows: int, seed: int) -> DataFrame:
    """The ``rows`` rows with the smallest key hash (the same ones for any partitioning).

    They are cut halfway between the hashes of the last row wanted and the next, so they stay spread
    over the cluster."""
    draw = F.pmod(F.xxhash64(*KEY, F.lit(seed)), F.lit(_SPACE))
    n = vectors.count()
    if n <= rows:
        return vectors
    hashed = vectors.select(draw.cast("double").alias("h"))
    cut = exact_quantiles(hashed, ["h"], (rows - 0.5) / (n - 1))["h"]
    return vectors.where(draw < F.lit(cut))


@dataclass
class LinearOneClass:
    weights: list[float]
    offset: float

    @classmethod
    def fit(
        cls,
        vectors: DataFrame,
        nu: float = 0.01,
        steps: int = 40,
        rate: float = 0.5,
        tol: float = 1e-4,
        max_rows: int | None = None,
        seed: int = 42,
    ) -> "LinearOneClass":
        """Fit on a stored table with the array column ``x``."""
        data = vectors if max_rows is None else subsample(vectors, max_rows, seed)
        data = data.select("x")
        first = data.first()
        if first is None:
            raise ValueError("no training rows")
        width = len(first["x"])
        w, b = np.zeros(width), 0.0
        best, best_loss, last_loss = (w, b), np.inf, np.inf
        for step in range(steps):
            grad, active, hinge, n = _gradient(data, w, b)
            loss = nu / 2 * float(w @ w) + b * nu + hinge / n
            if loss < best_loss:
                best, best_loss = (w.copy(), b), loss
            if abs(last_loss - loss) < tol * max(1.0, abs(loss)) and step > 5:
                break
            last_loss = loss
            eta = rate / np.sqrt(step + 1.0)
            w = w - eta * (nu * w - grad / n)
            b = b - eta * (nu - active / n)
        w, b = best
        return cls([float(v) for v in w], float(1 - b))

    def score(self, vectors: DataFrame) -> DataFrame:
        """Add ``anomaly_score = offset - w.x`` as a plain expression."""
        return vectors.withColumn("anomaly_score", linear_score(F.col("x"), self.weights, self.offset))

    def predict(self, vectors: DataFrame) -> DataFrame:
        label = F.when(F.col("anomaly_score") > 0, -1).otherwise(1)
        return self.score(vectors).withColumn("prediction", label)


def linear_score(x: Column, weights: list[float], offset: float) -> Column:
    products = F.zip_with(x, F.array(*[F.lit(w) for w in weights]), lambda a, c: a * c)
    return F.lit(offset) - F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)


def _gradient(data: DataFrame, w: np.ndarray, b: float):
    """Sum of rows inside the margin, their number, hinge sum and row count."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grad, active, hinge, n = np.zeros(len(w)), 0, 0.0, 0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.vstack(pdf["x"].to_numpy())
            short = 1 - (x @ w + b)
            inside = short > 0
            grad += x[inside].sum(axis=0)
            active += int(inside.sum())
            hinge += float(short[inside].sum())
            n += len(x)
        yield pd.DataFrame({"grad": [grad.tolist()], "active": [active], "hinge": [hinge], "n": [n]})

    parts = data.mapInPandas(partial, "grad ARRAY<DOUBLE>, active BIGINT, hinge DOUBLE, n BIGINT")
    width = len(w)
    row = parts.agg(
        *[F.sum(F.get("grad", F.lit(i))).alias(f"g{i}") for i in range(width)],
        F.sum("active").alias("active"), F.sum("hinge").alias("hinge"), F.sum("n").alias("n"),
    ).first()
    return np.array([row[f"g{i}"] for i in range(width)]), row["active"], row["hinge"], row["n"]

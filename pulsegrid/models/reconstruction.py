"""Reconstruction-error scores from principal components of flattened windows.

Windows may differ in length. Rows a window does not have stand at the mean of the windows that have
them while components are fitted, so they add nothing to the covariance, and count in no error."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F


def flat(tensor: Column) -> Column:
    """Window rows as one array, nulls as 0."""
    return F.transform(F.flatten(tensor), lambda v: F.coalesce(v, F.lit(0.0)))


def present(windows: DataFrame) -> Column:
    """Rows a window has: with ``n_samples``, padding behind them is left out."""
    tensor = F.col("tensor")
    return F.slice(tensor, F.lit(1), F.col("n_samples")) if "n_samples" in windows.columns else tensor


@dataclass
class Reconstruction:
    components: np.ndarray  # (inputs, k); bounded by window rows * features
    mean: np.ndarray
    n_features: int

    @classmethod
    def fit(cls, windows: DataFrame, n_features: int, k: int = 8) -> "Reconstruction":
        """Principal components of the ``tensor`` column (Spark ML computes the covariance)."""
        rows = windows.select(flat(present(windows)).alias("v")).where("size(v) > 0")
        width = rows.agg(F.max(F.size("v"))).first()[0]
        if width is None:
            raise ValueError("no training windows")
        absent = F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))
        ones = F.transform("v", lambda _: F.lit(1.0))
        means = rows.select(
            Summarizer.mean(array_to_vector(F.concat("v", absent))).alias("sum"),
            Summarizer.mean(array_to_vector(F.concat(ones, absent))).alias("share"),
        ).first()
        mean = means["sum"].toArray() / means["share"].toArray()
        tail = F.slice(F.lit(mean.tolist()), F.size("v") + 1, F.lit(width))
        whole = rows.select(array_to_vector(F.concat("v", tail)).alias("v"))
        model = PCA(k=min(k, width), inputCol="v", outputCol="p").fit(whole)
        return cls(model.pc.toArray(), mean, n_features)

    def score_per_feature(self, windows: DataFrame) -> DataFrame:
        """Add ``errors``: mean squared error over the rows of the window, one value per feature; null
        for a window without rows. A window longer than those fitted is read in pieces of that length."""
        pc, mean, width = self.components, self.mean, self.n_features

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                pieces, owner = [], []
                for i, v in enumerate(pdf["v"]):
                    for at in range(0, len(v), len(mean)):
                        pieces.append(v[at : at + len(mean)])
                        owner.append(i)
                sizes = np.array([len(p) for p in pieces], np.int64)
                there = np.arange(len(mean)) < sizes[:, None]
                x = np.zeros((len(pieces), len(mean)))
                if pieces:
                    x[there] = np.concatenate(pieces) - np.tile(mean, (len(pieces), 1))[there]
                miss = np.where(there, (x - (x @ pc) @ pc.T) ** 2, 0.0)
                total, rows = np.zeros((len(pdf), width)), np.zeros(len(pdf))
                np.add.at(total, np.array(owner, np.int64), miss.reshape(len(pieces), len(mean) // width, width).sum(axis=1))
                np.add.at(rows, np.array(owner, np.int64), sizes // width)
                errors = [t / n if n else None for t, n in zip(total, rows)]
                yield pdf.assign(errors=pd.Series(errors, index=pdf.index, dtype=object)).drop(columns="v")

        kept = [f for f in windows.schema.fields if f.name != "tensor"]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
        rows = windows.select(*[f.name for f in kept], F.coalesce(flat(present(windows)), F.array().cast("array<double>")).alias("v"))
        return rows.mapInPandas(run, f"{schema}, errors ARRAY<DOUBLE>")

    def score(self, windows: DataFrame) -> DataFrame:
        """Add ``anomaly_score``: mean squared error of the whole window."""
        total = F.aggregate("errors", F.lit(0.0), lambda a, v: a + v) / F.size("errors")
        return self.score_per_feature(windows).withColumn("anomaly_score", total).drop("errors")

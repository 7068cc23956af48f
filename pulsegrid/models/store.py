"""Model artefacts as small Parquet tables: nodes, scaler, feature order, settings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import SparkSession

from pulsegrid.models.forest import IsolationForest
from pulsegrid.operators.scaling import Scaler


@dataclass
class ForestArtefact:
    forest: IsolationForest
    scaler: Scaler
    features: list[str]

    def save(self, spark: SparkSession, path: str) -> None:
        self.forest.nodes.write.parquet(f"{path}/nodes")
        self.scaler.table(spark).write.parquet(f"{path}/scaler")
        order = list(enumerate(self.features))
        spark.createDataFrame(order, "position INT, feature STRING").write.parquet(f"{path}/features")
        settings = [(self.forest.sample, self.forest.offset)]
        spark.createDataFrame(settings, "sample INT, offset DOUBLE").write.parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "ForestArtefact":
        settings = spark.read.parquet(f"{path}/settings").first()
        order = spark.read.parquet(f"{path}/features").orderBy("position").collect()
        return cls(
            IsolationForest(spark.read.parquet(f"{path}/nodes"), settings["sample"], settings["offset"]),
            Scaler.from_table(spark.read.parquet(f"{path}/scaler")),
            [r["feature"] for r in order],
        )

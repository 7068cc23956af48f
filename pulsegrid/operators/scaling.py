"""Median imputation and standard scaling of summary columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulsegrid.functions.quantiles import exact_quantiles, literal


def medians(df: DataFrame, columns: list[str]) -> dict[str, float | None]:
    """Exact median per column (one number per column reaches the driver)."""
    return exact_quantiles(df, columns, 0.5)


def impute(df: DataFrame, values: dict[str, float | None]) -> DataFrame:
    """Replace nulls by the given value; columns without one (all null) stay null."""
    filled = {c: v for c, v in values.items() if v is not None}
    return df.selectExpr(
        *[f"coalesce({c}, {literal(filled[c])}) as {c}" if c in filled else f"`{c}`" for c in df.columns]
    )


@dataclass(frozen=True)
class Scaler:
    """Mean and scale per column; a constant column has scale 1."""

    columns: list[str]
    mean: list[float]
    scale: list[float]

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str]) -> "Scaler":
        """One map-side combined aggregate; the result is two numbers per column."""
        row = df.agg(
            *[F.expr(f"avg({c}) as m{i}") for i, c in enumerate(columns)],
            *[F.expr(f"stddev_pop({c}) as s{i}") for i, c in enumerate(columns)],
        ).first()
        mean = [row[f"m{i}"] or 0.0 for i in range(len(columns))]
        scale = [row[f"s{i}"] or 1.0 for i in range(len(columns))]
        return cls(list(columns), mean, scale)

    def scaled(self) -> dict[str, str]:
        """SQL expression of each scaled column."""
        return {
            c: f"({c} - {m!r}D) / {s!r}D" for c, m, s in zip(self.columns, self.mean, self.scale)
        }

    def transform(self, df: DataFrame) -> DataFrame:
        by = self.scaled()
        return df.selectExpr(*[f"{by[c]} as {c}" if c in by else f"`{c}`" for c in df.columns])

    def vector(self, df: DataFrame, out: str = "x") -> DataFrame:
        """Scaled columns as one array; what is still null counts as the mean (0)."""
        items = ", ".join(f"coalesce({e}, 0D)" for e in self.scaled().values())
        kept = [f"`{c}`" for c in df.columns if c not in self.columns]
        return df.selectExpr(*kept, f"array({items}) as {out}")

    def table(self, spark: SparkSession) -> DataFrame:
        rows = list(zip(range(len(self.columns)), self.columns, self.mean, self.scale))
        return spark.createDataFrame(rows, "position INT, feature STRING, mean DOUBLE, scale DOUBLE")

    @classmethod
    def from_table(cls, table: DataFrame) -> "Scaler":
        rows = table.orderBy("position").collect()
        return cls([r.feature for r in rows], [r.mean for r in rows], [r.scale for r in rows])


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    return Scaler.fit(df, columns).transform(df)

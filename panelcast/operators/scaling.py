"""Standardisation with population deviation, kept as a small parameter set."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and deviation per column; as large as the column list, not the data."""

    means: dict[str, float]
    deviations: dict[str, float]

    def apply(self, df: DataFrame, suffix: str = "") -> DataFrame:
        """Scaled columns; the parameters enter the plan as literals."""
        return df.withColumns(
            {f"{c}{suffix}": (F.col(c) - F.lit(m)) / F.lit(self.deviations[c]) for c, m in self.means.items()}
        )

    def to_table(self, spark: SparkSession) -> DataFrame:
        rows = [(c, m, self.deviations[c]) for c, m in self.means.items()]
        return spark.createDataFrame(rows, "feature string, mean double, deviation double")

    @staticmethod
    def from_table(table: DataFrame, columns: list[str]) -> Scaler:
        """Saved parameters in the order of `columns`."""
        rows = {r["feature"]: r for r in table.where(F.col("feature").isin(columns)).collect()}
        missing = [c for c in columns if c not in rows]
        if missing:
            raise ValueError(f"no saved parameters for {missing}")
        return Scaler({c: rows[c]["mean"] for c in columns}, {c: rows[c]["deviation"] for c in columns})


def fit_scaler(df: DataFrame, columns: list[str]) -> Scaler:
    """One aggregate over the rows; a column without spread is divided by 1."""
    stats = df.agg(
        *[F.avg(c).alias(f"m_{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"d_{i}") for i, c in enumerate(columns)],
    ).first()
    return Scaler(
        {c: stats[f"m_{i}"] if stats[f"m_{i}"] is not None else 0.0 for i, c in enumerate(columns)},
        {c: stats[f"d_{i}"] or 1.0 for i, c in enumerate(columns)},
    )

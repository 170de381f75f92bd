"""Regression and classification scores; rows with a missing side never count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def error_terms(actual: str, predicted: str) -> dict[str, Column]:
    """Mean absolute error, root mean squared error and bias as aggregates."""
    gap = F.col(predicted) - F.col(actual)
    return {"mae": F.avg(F.abs(gap)), "rmse": F.sqrt(F.avg(gap * gap)), "bias": F.avg(gap)}


def regression_scores(df: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    terms = [F.count(F.lit(1)).alias("n"), *[e.alias(n) for n, e in error_terms(actual, predicted).items()]]
    return known.groupBy(*(keys or [])).agg(*terms)


def accuracy(df: DataFrame, actual: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    hit = F.when(F.col(actual).cast("int") == F.col(predicted).cast("int"), 1.0).otherwise(0.0)
    return known.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), F.avg(hit).alias("accuracy"))


def pair_counts(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    known = df.where(F.col(actual).isNotNull() & F.col(predicted).isNotNull())
    return known.groupBy(F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def classification_report(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support per label, then the macro and the weighted average.

    Works on the counted pairs; a division by zero gives 0.
    """
    pairs = pair_counts(df, actual, predicted)
    hit = F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)
    none = F.lit(0).cast("long")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("n").alias("support"), none.alias("named"), hit.alias("hits")),
        F.struct(F.col("predicted").alias("label"), none.alias("support"), F.col("n").alias("named"), none.alias("hits")),
    )
    totals = pairs.select(F.inline(sides)).groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "named", "hits")])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(F.lit(0.0))

    rated = totals.select(
        F.col("label").cast("string").alias("label"),
        ratio(F.col("hits"), F.col("named")).alias("precision"),
        ratio(F.col("hits"), F.col("support")).alias("recall"),
        ratio(2 * F.col("hits"), F.col("named") + F.col("support")).alias("f1"),
        "support",
    )
    names = ("precision", "recall", "f1")
    grouped = rated.rollup("label").agg(
        F.grouping("label").alias("_all"),
        *[F.avg(c).alias(c) for c in names],
        *[ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(f"_{c}") for c in names],
        F.sum("support").alias("support"),
    )
    plain = F.struct(F.col("label").alias("name"), *[F.col(c).alias(c) for c in names])
    macro = F.struct(F.lit("macro avg").alias("name"), *[F.col(c).alias(c) for c in names])
    weighted = F.struct(F.lit("weighted avg").alias("name"), *[F.col(f"_{c}").alias(c) for c in names])
    rows = F.when(F.col("_all") == 1, F.array(macro, weighted)).otherwise(F.array(plain))
    return grouped.select("support", F.inline(rows)).select(F.col("name").alias("label"), *names, "support")


def confusion_matrix(df: DataFrame, actual: str, predicted: str, labels: list[int]) -> DataFrame:
    """One row per label seen on either side, one column `predicted_{label}` per label, 0 where nothing was counted."""
    pairs = pair_counts(df, actual, predicted)
    none = F.lit(None).cast("int")
    sides = F.array(
        F.struct(F.col("actual").alias("label"), F.col("predicted").alias("named"), F.col("n").alias("count")),
        F.struct(F.col("predicted").alias("label"), none.alias("named"), F.lit(0).cast("long").alias("count")),
    )
    cells = [
        F.coalesce(F.sum(F.when(F.col("named") == k, F.col("count"))), F.lit(0)).cast("long").alias(f"predicted_{k}")
        for k in labels
    ]
    rows = pairs.select(F.inline(sides)).where(F.col("label").isin(labels))
    return rows.groupBy(F.col("label").alias("actual")).agg(*cells)


def average_over(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Means over sessions; a session without a score does not count."""
    return df.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("sessions"), *[F.avg(c).alias(c) for c in columns])

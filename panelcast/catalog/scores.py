"""Scores of a naive forecast on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import GRADED, graded, rounded
from panelcast.catalog.registry import query
from panelcast.operators.scores import accuracy, classification_report, confusion_matrix, regression_scores

KNOWN = "actual_label IS NOT NULL AND predicted_label IS NOT NULL"


@query(
    "mae",
    f"""WITH {GRADED} SELECT series_id, count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae,
    round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse,
    round(avg(predicted - actual), 6) + 0.0 AS bias
    FROM graded WHERE actual IS NOT NULL AND predicted IS NOT NULL GROUP BY 1""",
)
def mae(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(regression_scores(graded(spark, sf), "actual", "predicted", ["series_id"]), ["mae", "rmse", "bias"], 6)


@query(
    "accuracy",
    f"""WITH {GRADED} SELECT series_id, count(*) AS n,
    round(avg(CASE WHEN actual_label = predicted_label THEN 1.0 ELSE 0.0 END), 6) AS accuracy
    FROM graded WHERE {KNOWN} GROUP BY 1""",
)
def accuracy_of_series(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(accuracy(graded(spark, sf), "actual_label", "predicted_label", ["series_id"]), ["accuracy"], 6)


@query(
    "classification_report",
    f"""WITH {GRADED}, known AS (SELECT actual_label AS a, predicted_label AS p FROM graded WHERE {KNOWN}),
    labels AS (SELECT a AS label FROM known UNION SELECT p FROM known),
    counts AS (
      SELECT label, (SELECT count(*) FROM known WHERE a = label) AS support,
        (SELECT count(*) FROM known WHERE p = label) AS named,
        (SELECT count(*) FROM known WHERE a = label AND p = label) AS hits FROM labels),
    rated AS (
      SELECT CAST(label AS VARCHAR) AS label, coalesce(hits / nullif(named, 0), 0) AS precision,
        coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(named + support, 0), 0) AS f1, support
      FROM counts),
    report AS (
      SELECT * FROM rated
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rated
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM rated)
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
      CAST(support AS BIGINT) AS support FROM report""",
)
def report(spark: SparkSession, sf: str) -> DataFrame:
    rows = classification_report(graded(spark, sf), "actual_label", "predicted_label")
    return rounded(rows, ["precision", "recall", "f1"], 6)


@query(
    "confusion_matrix",
    f"WITH {GRADED}, known AS (SELECT actual_label AS a, predicted_label AS p FROM graded WHERE {KNOWN}), "
    "labels AS (SELECT a AS label FROM known UNION SELECT p FROM known) SELECT label AS actual, "
    + ", ".join(f"(SELECT count(*) FROM known WHERE a = label AND p = {k}) AS predicted_{k}" for k in range(4))
    + " FROM labels",
)
def confusion(spark: SparkSession, sf: str) -> DataFrame:
    rows = confusion_matrix(graded(spark, sf), "actual_label", "predicted_label", [0, 1, 2, 3])
    return rows.withColumn("actual", F.col("actual").cast("int"))

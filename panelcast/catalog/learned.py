"""Scaling, clusters, forests and the full pipelines on the given tables."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import MEASURES, iso, measures, rounded, stored_measures, table
from panelcast.catalog.registry import query
from panelcast.operators.cluster import choose_k, fit_labels, nearest_centre, score_candidates, silhouette
from panelcast.operators.folds import folds_or_split
from panelcast.operators.forests import apply_model, class_weights, fit_classifier
from panelcast.operators.resample import day_span, fill_gaps
from panelcast.operators.scaling import Scaler, fit_scaler
from panelcast.plans.evaluation import SCORES, backtest_average, backtest_models, evaluate_range, evaluation_scores, save_evaluation
from panelcast.plans.features import FeatureSpec
from panelcast.plans.forecasting import forecast_days
from panelcast.plans.training import (
    Bundle,
    TrainSpec,
    fit_models,
    label_days,
    split_parts,
    train_bundle,
    train_if_missing,
    with_high_low,
)
from panelcast.session import fresh_path, materialise

KEYS = ["series_id"]
POINT = ["temperature", "humidity", "wind", "cloud"]
LABEL_FEATURES = [*POINT, "rain"]
FEATURES = FeatureSpec(
    KEYS,
    "temperature",
    LABEL_FEATURES,
    dew=("temperature", "humidity"),
    pairs={"temp_x_humidity": ("temperature", "humidity"), "wind_x_cloud": ("wind", "cloud")},
    poly=["temperature", "wind"],
)
TRAIN = TrainSpec(LABEL_FEATURES, "temperature_max", "temperature_min", "cloud")
# queries that fit many forests take smaller ones; README names the times of both sizes
SMALLER = replace(TRAIN, trees=20, depth=10)
CUTOFF = date(2000, 7, 1)


def daily_measures(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(spark, fill_gaps(measures(spark, sf), KEYS), "measures")


def split_by_share(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Feature rows of the first 80 % of the days of each series, and of the rest; all that is fitted comes from the first part."""
    daily = daily_measures(spark, sf)
    whole = day_span(daily, KEYS)
    # no series is long enough for windows, so each is split once
    return split_parts(spark, daily, folds_or_split(whole, KEYS, train_days=1 << 30), FEATURES, TRAIN)


SCALED = ", ".join(f"round(({c} - m_{c}) / d_{c}, 6) + 0.0 AS {c}" for c in POINT)
FITTED = ", ".join(f"avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}" for c in POINT)


@query(
    "standardize",
    f"""WITH {MEASURES}, fitted AS (SELECT {FITTED} FROM measures WHERE day < DATE '2000-07-01')
    SELECT series_id, strftime(day, '%Y-%m-%d') AS day, {SCALED} FROM measures, fitted""",
)
def standardize(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_measures(spark, sf)
    scaler = fit_scaler(rows.where(F.col("day") < F.lit(CUTOFF)), POINT)
    return rounded(scaler.apply(rows).select("series_id", iso("day").alias("day"), *POINT), POINT, 6)


ITEM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "standardize_apply",
    f"""WITH fitted AS (
      SELECT {', '.join(f'avg({c}) AS m_{c}, stddev_pop({c}) AS d_{c}' for c in ITEM)} FROM lineitem
      WHERE l_shipdate < TIMESTAMP '2000-07-01')
    SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - m_{c}) / d_{c}, 6) + 0.0 AS {c}' for c in ITEM)}
    FROM lineitem, fitted""",
)
def standardize_apply(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    fitted = fit_scaler(rows.where(F.col("l_shipdate") < F.lit(CUTOFF).cast("timestamp_ntz")), ITEM)
    saved = materialise(spark, fitted.to_table(spark), "scaler")
    scaler = Scaler.from_table(saved, list(reversed(ITEM)))
    return rounded(scaler.apply(rows).select("l_orderkey", "l_linenumber", *ITEM), ITEM, 6)


CENTRES = """centres AS (
  SELECT quarter(day) - 1 AS label, round(avg(temperature), 6) AS c1,
    round(avg(humidity), 6) AS c2, round(avg(wind), 6) AS c3, round(avg(cloud), 6) AS c4 FROM measures GROUP BY 1)"""
NEAREST = f"""{MEASURES}, {CENTRES}, distances AS (
  SELECT m.*, c.label, (temperature - c1) * (temperature - c1) + (humidity - c2) * (humidity - c2)
    + (wind - c3) * (wind - c3) + (cloud - c4) * (cloud - c4) AS distance
  FROM measures m, centres c),
assigned AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, day ORDER BY distance, label) AS rn FROM distances)"""


def stored_centres(rows: DataFrame) -> list[tuple[int, list[float]]]:
    """Four centres: the means of the days of each quarter of the year."""
    by_quarter = rows.groupBy((F.quarter("day") - 1).alias("label"))
    means = by_quarter.agg(*[F.round(F.avg(c), 6).alias(c) for c in POINT]).orderBy("label").collect()
    return [(m["label"], [m[c] for c in POINT]) for m in means]


@query(
    "kmeans_assign",
    f"WITH {NEAREST} SELECT series_id, strftime(day, '%Y-%m-%d') AS day, CAST(label AS INTEGER) AS label FROM assigned WHERE rn = 1",
)
def kmeans_assign(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_measures(spark, sf)
    label = nearest_centre(POINT, stored_centres(rows))
    return rows.select("series_id", iso("day").alias("day"), label.alias("label"))


NORM = " + ".join(f"{c} * {c}" for c in POINT)
DOT = " + ".join(f"{c} * s_{c}" for c in POINT)


@query(
    "silhouette",
    f"""WITH {NEAREST}, points AS (SELECT series_id, day, label, {', '.join(POINT)} FROM assigned WHERE rn = 1),
    stats AS (
      SELECT label AS cluster, count(*) AS n, sum({NORM}) AS squares, {', '.join(f'sum({c}) AS s_{c}' for c in POINT)}
      FROM points GROUP BY 1),
    means AS (
      SELECT series_id, day, label, cluster, n, {NORM} + squares / n - 2 * ({DOT}) / n AS d FROM points, stats),
    scored AS (
      SELECT series_id, day, max(CASE WHEN label = cluster AND n > 1 THEN d * n / (n - 1) END) AS a,
        min(CASE WHEN label <> cluster THEN d END) AS b FROM means GROUP BY 1, 2)
    SELECT round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) + 0.0 AS silhouette FROM scored""",
)
def silhouette_of_labels(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_measures(spark, sf)
    labelled = rows.withColumn("label", nearest_centre(POINT, stored_centres(rows)))
    return rounded(silhouette(labelled, POINT, "label"), ["silhouette"], 6)


@query("kmeans_fit")
def kmeans_fit(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_measures(spark, sf)
    return apply_model(fit_labels(rows, LABEL_FEATURES, k=7), rows, ["series_id", "day", "label"])


@query("kmeans_select_k")
def kmeans_select_k(spark: SparkSession, sf: str) -> DataFrame:
    scores = score_candidates(stored_measures(spark, sf), LABEL_FEATURES)
    best = choose_k(scores)
    rows = [(k, score, int(k == best)) for k, score in scores]
    return spark.createDataFrame(rows, "k int, silhouette double, chosen int")


@query(
    "class_weights",
    """WITH counts AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1)
    SELECT label, n, round((SELECT sum(n) FROM counts) / ((SELECT count(*) FROM counts) * n), 6) AS weight FROM counts""",
)
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").withColumnRenamed("o_orderpriority", "label")
    return rounded(class_weights(rows, "label"), ["weight"], 6)


@query("rf_classify")
def rf_classify(spark: SparkSession, sf: str) -> DataFrame:
    """The class of the test days by a balanced forest; classes are those of the training days' clusters."""
    train, test = split_by_share(spark, sf)
    labels = fit_labels(train, LABEL_FEATURES, TRAIN.k)
    labelled = label_days(train, labels, FEATURES, TRAIN.label_lead)
    model = fit_classifier(labelled, FEATURES.columns, "label", TRAIN.trees, TRAIN.depth)
    return apply_model(model, label_days(test, labels, FEATURES, TRAIN.label_lead), ["series_id", "day", "label", "predicted_label"])


@query("rf_regress")
def rf_regress(spark: SparkSession, sf: str) -> DataFrame:
    """Maximum and minimum of the test days from the mean forecast, the predicted class, cloud and season."""
    train, test = split_by_share(spark, sf)
    scored = with_high_low(Bundle(fit_models(train, FEATURES, SMALLER), {}), test)
    return scored.select("series_id", "day", "temperature_max", "predicted_maximum", "temperature_min", "predicted_minimum")


@query("stacked_minmax")
def stacked_minmax(spark: SparkSession, sf: str) -> DataFrame:
    """The same for all days from a date on, k by silhouette, the class of the next day as the classifier's target."""
    daily = daily_measures(spark, sf)
    span = day_span(daily, KEYS).where((F.col("first_day") < F.lit(CUTOFF)) & (F.col("last_day") >= F.lit(CUTOFF)))
    fold = span.select(
        "series_id",
        F.lit(1).alias("fold"),
        F.col("first_day").alias("train_start"),
        F.date_sub(F.lit(CUTOFF), 1).alias("train_end"),
        F.lit(CUTOFF).alias("test_start"),
        F.col("last_day").alias("test_end"),
    )
    spec = replace(SMALLER, k=None, label_lead=1)
    train, test = split_parts(spark, daily, fold, FEATURES, spec)
    scored = with_high_low(Bundle(fit_models(train, FEATURES, spec), {}), test)
    return scored.select("series_id", "day", "predicted_label", "predicted_maximum", "predicted_minimum")


@query(
    "model_roundtrip",
    f"WITH {MEASURES} SELECT series_id, count(*) AS days, CAST(0 AS BIGINT) AS changed FROM measures GROUP BY 1",
)
def model_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Days per series, and how many of them a saved and loaded model labels otherwise."""
    rows = stored_measures(spark, sf)
    path = f"{fresh_path(spark, 'models')}/labels"
    model = fit_labels(rows, LABEL_FEATURES, k=5)
    model.write().overwrite().save(path)
    before = apply_model(model, rows, ["series_id", "day", "label"])
    after = apply_model(PipelineModel.load(path), rows, ["series_id", "day", F.col("label").alias("label_after")])
    changed = F.sum(F.when(F.col("label") == F.col("label_after"), 0).otherwise(1))
    both = before.join(after, ["series_id", "day"])
    return both.groupBy("series_id").agg(F.count(F.lit(1)).alias("days"), changed.alias("changed"))


@query("train_if_missing")
def train_when_missing(spark: SparkSession, sf: str) -> DataFrame:
    daily, path = daily_measures(spark, sf), fresh_path(spark, "bundle")
    _, first = train_if_missing(spark, path, daily, FEATURES, SMALLER)
    bundle, second = train_if_missing(spark, path, daily, FEATURES, SMALLER)
    model = bundle.tables["forecaster"].select("series_id", F.concat_ws(",", "lags").alias("lags"))
    return model.withColumns({"trained_first": F.lit(int(first)), "trained_again": F.lit(int(second))})


@query("forecast_7d")
def forecast_7d(spark: SparkSession, sf: str) -> DataFrame:
    daily = daily_measures(spark, sf)
    bundle = train_bundle(spark, daily, FEATURES, TRAIN)
    return forecast_days(daily, bundle, FEATURES, TRAIN, 7, ["humidity", "wind", "cloud"])


def evaluated(spark: SparkSession, sf: str) -> DataFrame:
    daily = daily_measures(spark, sf)
    start, end = date(2001, 1, 1), date(2001, 6, 2)
    bundle = train_bundle(spark, daily.where(F.col("day") < F.lit(start)), FEATURES, SMALLER)
    results = evaluate_range(daily, bundle, FEATURES, SMALLER, start, end)
    return save_evaluation(spark, results, fresh_path(spark, "evaluation"), start)


@query("historical_evaluation")
def historical_evaluation(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated(spark, sf)


@query("historical_scores")
def historical_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of the mean and accuracy of the class over the complete days of the evaluation."""
    scores = evaluation_scores(evaluated(spark, sf), list(range(SMALLER.k)))
    return scores["mean"].join(scores["accuracy"], "n").withColumnRenamed("n", "days")


@query("backtest_models")
def backtest_forests(spark: SparkSession, sf: str) -> DataFrame:
    """One row for each of the last ten 30-day folds, and the averages over them as fold 0."""
    scores = backtest_models(spark, daily_measures(spark, sf), FEATURES, SMALLER, test_days=30, last=10)
    average = backtest_average(scores).select(F.lit(0).alias("fold"), F.col("sessions").alias("days"), *SCORES)
    return scores.unionByName(average)

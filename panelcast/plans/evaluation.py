"""Back-tests of the trained models over folds, and the evaluation of a past range."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from datetime import date

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.present import describe_label
from panelcast.operators.autoreg import refit_selected
from panelcast.operators.combine import forecast_beside_actual
from panelcast.operators.foldfits import backtest_direct, fold_models
from panelcast.operators.folds import folds_every, folds_last
from panelcast.operators.forests import apply_keeping_gaps
from panelcast.operators.scores import accuracy, average_over, classification_report, confusion_matrix, regression_scores
from panelcast.plans.features import FeatureSpec, build_features
from panelcast.plans.training import Bundle, TrainSpec, base_rows, fit_models, fold_parts, label_days, with_high_low
from panelcast.session import discard, materialise
from panelcast.sources.writers import write_csv


SCORES = ["accuracy", "mean_mae", "maximum_mae", "minimum_mae"]


def score_fold(train_rows: DataFrame, test_rows: DataFrame, features: FeatureSpec, train: TrainSpec, fold: int) -> DataFrame:
    """Train on one side, score on the other: accuracy and the errors of mean, maximum and minimum."""
    models = fit_models(train_rows, features, train)
    labelled = label_days(test_rows, models["labels"], features, train.label_lead)
    scored = with_high_low(Bundle(models, {}), labelled)
    hit = F.when(F.col("label") == F.col("predicted_label"), 1.0).when(F.col("label").isNotNull(), 0.0)

    def error(actual: str, predicted: str) -> Column:
        return F.avg(F.abs(F.col(actual) - F.col(predicted)))

    return scored.agg(
        F.lit(fold).alias("fold"),
        F.count(F.lit(1)).alias("days"),
        F.avg(hit).alias("accuracy"),
        error(features.mean, "mean_forecast").alias("mean_mae"),
        error(train.high, "predicted_maximum").alias("maximum_mae"),
        error(train.low, "predicted_minimum").alias("minimum_mae"),
    )


def common_folds(daily: DataFrame, features: FeatureSpec, test_days: int = 60, train_days: int = 365, last: int | None = None) -> DataFrame:
    """Every full window of `test_days` after the first `train_days` of the panel, or the `last` ones; the same dates for all series."""
    span = daily.agg(F.min(features.day).alias("first_day"), F.max(features.day).alias("last_day"))
    span = span.withColumn("_panel", F.lit(1))
    windows = folds_every(span, ["_panel"], test_days, train_days) if last is None else folds_last(span, ["_panel"], last, test_days, train_days)
    windows = windows.drop("_panel")
    # few rows, bounded by the calendar, that enter the plan as literals; every series has them all
    found = [F.struct(*[F.lit(r[c]).alias(c) for c in windows.columns]) for r in windows.orderBy("fold").collect()]
    series = daily.select(*features.keys).distinct()
    if not found:
        return series.select(*features.keys, *[F.lit(None).cast(f.dataType).alias(f.name) for f in windows.schema.fields]).limit(0)
    return series.select(*features.keys, F.inline(F.array(*found)))


def backtest_models(
    spark: SparkSession,
    daily: DataFrame,
    features: FeatureSpec,
    train: TrainSpec,
    test_days: int = 60,
    train_days: int = 365,
    last: int | None = None,
    at_once: int = 4,
) -> DataFrame:
    """One row per fold of all series together: days, accuracy and the errors of mean, maximum and minimum.

    Of every full window of `test_days` after the first `train_days`, or the `last` ones, forecaster, labels, scaler and forests are fitted on the
    days before it alone, and the mean of its days is forecast from its first day on. The forecasters of all folds
    are one job. Forests are fitted fold by fold, `at_once` folds at a time, as the stages of one seldom fill a cluster.
    """
    keys = [*features.keys, features.day]
    folds = materialise(spark, common_folds(daily, features, test_days, train_days, last), "folds")
    models = materialise(spark, fold_models(daily, folds, features.keys, features.mean, day=features.day), "models")
    ahead = materialise(spark, backtest_direct(daily.select(*keys, features.mean), folds, models, features.keys, features.mean, day=features.day), "ahead")
    base = base_rows(spark, daily, features, train)
    numbers = sorted(r["fold"] for r in folds.select("fold").distinct().collect())

    def one(fold: int) -> Row:
        this = F.col("fold") == fold
        parts = fold_parts(daily, base, folds.where(this), models.where(this).drop("fold"), ahead.where(this), features)
        stored = [materialise(spark, part, "part") for part in parts]
        row = score_fold(*stored, features, train, fold).first()
        discard(*stored)
        return row

    with ThreadPoolExecutor(at_once) as pool:
        rows = list(pool.map(one, numbers))
    discard(folds, models, ahead, base)
    schema = "fold int, days long, " + ", ".join(f"{c} double" for c in SCORES)
    return spark.createDataFrame([tuple(r) for r in rows], schema)


def backtest_average(scores: DataFrame) -> DataFrame:
    """The means over the folds; a fold without a score does not count."""
    return average_over(scores, SCORES)


def evaluate_range(
    daily: DataFrame,
    bundle: Bundle,
    features: FeatureSpec,
    train: TrainSpec,
    start: date,
    end: date,
) -> DataFrame:
    """One row per day of the range: actual and predicted mean and class.

    The mean is a one-step forecast by the order that the bundle's forecaster has selected, refitted on all days before each
    day; a day without features keeps NULL results.
    """
    keys = [*features.keys, features.day]
    day = F.col(features.day)
    wanted = day.between(F.lit(start), F.lit(end))
    means = refit_selected(daily, bundle.tables["forecaster"], features.keys, features.mean, day=features.day, days=wanted)
    rows = build_features(daily, features)
    rows = label_days(rows, bundle.models["labels"], features, train.label_lead)
    rows = apply_keeping_gaps(bundle.models["classifier"], rows, "predicted_label")
    span = daily.select(*features.keys).distinct()
    days = F.sequence(F.lit(start), F.lit(end))
    calendar = span.select(*features.keys, F.explode(days).alias(features.day))
    inside = day.between(F.lit(start), F.lit(end))
    actual = rows.where(inside).select(
        *keys,
        F.col(features.mean).alias("actual_mean"),
        F.col("label").cast("int").alias("actual_label"),
        F.col("predicted_label").cast("int").alias("predicted_label"),
    )
    forecast = means.where(inside).select(*keys, F.col("forecast").alias("predicted_mean"))
    joined = forecast_beside_actual(calendar, actual, forecast, keys)
    # a day that cannot be scored by the classifier is not scored at all
    usable = F.col("predicted_label").isNotNull()
    masked = {c: F.when(usable, F.col(c)) for c in ("actual_mean", "predicted_mean", "actual_label")}
    named = joined.withColumns(masked)
    return named.withColumns(
        {
            "actual_condition": describe_label(F.col("actual_label"), {}, unknown="N/A"),
            "predicted_condition": describe_label(F.col("predicted_label"), {}, unknown="N/A"),
        }
    )


def evaluation_scores(results: DataFrame, labels: list[int]) -> dict[str, DataFrame]:
    """Mean error, accuracy, report and confusion matrix over the complete rows."""
    known = results.dropna(subset=["actual_mean", "predicted_mean", "actual_label", "predicted_label"])
    return {
        "mean": regression_scores(known, "actual_mean", "predicted_mean"),
        "accuracy": accuracy(known, "actual_label", "predicted_label"),
        "report": classification_report(known, "actual_label", "predicted_label"),
        "confusion": confusion_matrix(known, "actual_label", "predicted_label", labels),
    }


def save_evaluation(spark: SparkSession, results: DataFrame, folder: str, start: date) -> DataFrame:
    """Write the result rows as CSV and read them back typed."""
    path = write_csv(results, folder, "historical", start)
    return spark.read.schema(results.schema).option("header", True).csv(path)

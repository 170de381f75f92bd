"""Training of a full bundle: labels, classifier, mean forecaster, stacked maximum and minimum."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.dates import SEASON_FLAGS
from panelcast.operators.autoreg import fitted_selected, select_model
from panelcast.operators.foldfits import backtest_direct, fitted_in_fold, fold_models
from panelcast.operators.cluster import choose_k, fit_labels, score_candidates
from panelcast.operators.forests import apply_keeping_gaps, fit_classifier, fit_regressor
from panelcast.operators.frames import next_day
from panelcast.plans.features import FeatureSpec, build_features
from panelcast.session import materialise
from panelcast.sources.bundles import MODEL_PARTS, TABLE_PARTS, load_bundle, save_bundle


@dataclass(frozen=True)
class TrainSpec:
    """What is trained on top of the features."""

    label_features: list[str]
    high: str
    low: str
    cloud: str
    k: int | None = 7
    label_lead: int = 0
    trees: int = 100
    depth: int = 30
    high_low_depth: int = 10
    seed: int = 42


@dataclass
class Bundle:
    models: dict[str, PipelineModel]
    tables: dict[str, DataFrame]

    @property
    def complete(self) -> bool:
        """All parts are there and the label centres are as wide as the inputs of their scaler."""
        if any(p not in self.models for p in MODEL_PARTS) or any(p not in self.tables for p in TABLE_PARTS):
            return False
        labels = self.models["labels"]
        assembler, centres = labels.stages[0], labels.stages[-1].clusterCenters()
        return isinstance(assembler, VectorAssembler) and len(assembler.getInputCols()) == len(centres[0])


def stack_inputs(spec: TrainSpec) -> list[str]:
    """What the maximum and minimum regressors see: mean forecast, class, cloud and season."""
    return ["mean_forecast", "predicted_label", spec.cloud, *[f"season_{s}" for s in SEASON_FLAGS]]


def label_days(rows: DataFrame, labels: PipelineModel, spec: FeatureSpec, lead: int) -> DataFrame:
    """Adds the class of the day, or of the day `lead` rows later."""
    labelled = apply_keeping_gaps(labels, rows, "label")
    if lead == 0:
        return labelled
    return next_day(labelled, {"label": "label"}, spec.keys, spec.day, lead)


def fit_label_model(rows: DataFrame, train: TrainSpec) -> PipelineModel:
    """k-means with the given k, or with the k of the best silhouette."""
    k = train.k
    if k is None:
        k = choose_k(score_candidates(rows, train.label_features, seed=train.seed))
    return fit_labels(rows, train.label_features, k, train.seed)


def fit_models(rows: DataFrame, features: FeatureSpec, train: TrainSpec) -> dict[str, PipelineModel]:
    """Models from feature rows that hold `mean_forecast`, the daily maximum and the daily minimum."""
    labels = fit_label_model(rows, train)
    labelled = label_days(rows, labels, features, train.label_lead)
    classifier = fit_classifier(labelled, features.columns, "label", train.trees, train.depth, train.seed)
    inputs = stack_inputs(train)
    # the classifier scores the training rows once; both regressors read the few columns they need
    stacked = apply_keeping_gaps(classifier, labelled, "predicted_label").select(*inputs, train.high, train.low).persist()
    models = {"labels": labels, "classifier": classifier}
    try:
        for part, target in (("maximum", train.high), ("minimum", train.low)):
            models[part] = fit_regressor(
                stacked, inputs, target, f"predicted_{part}", train.trees, train.high_low_depth, train.seed
            )
    finally:
        stacked.unpersist()
    return models


def training_rows(
    spark: SparkSession, daily: DataFrame, forecaster: DataFrame, features: FeatureSpec, train: TrainSpec
) -> DataFrame:
    """The feature table all fits of a bundle read, written once."""
    wanted = [c for c in dict.fromkeys(["mean_forecast", train.high, train.low, train.cloud]) if c not in features.columns]
    fitted = fitted_selected(daily, forecaster, features.keys, features.mean, day=features.day, name="mean_forecast")
    rows = build_features(fitted, features, wanted)
    return materialise(spark, rows.dropna(), "features")


def fold_parts(
    daily: DataFrame, base: DataFrame, folds: DataFrame, models: DataFrame, ahead: DataFrame, features: FeatureSpec
) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one fold; nothing in the training rows and no mean forecast comes from a test day.

    base: feature rows without `mean_forecast`; models: the forecaster of each series in this fold; ahead: forecasts of its test
    days from the fold's end. Training days get the in-sample value of the fold's model.
    """
    keys, day = features.keys, features.day
    ends = folds.select(*keys, F.col("train_end").alias("_end"))
    before = daily.join(ends, keys).where(F.col(day) <= F.col("_end")).drop("_end")
    fitted = fitted_in_fold(before, models, keys, features.mean, day=day, name="mean_forecast").select(*keys, day, "mean_forecast")
    train = base.join(fitted, [*keys, day])
    test = base.join(ahead.select(*keys, day, F.col("forecast").alias("mean_forecast")), [*keys, day])
    return train.dropna(), test.dropna()


def base_rows(spark: SparkSession, daily: DataFrame, features: FeatureSpec, train: TrainSpec) -> DataFrame:
    """The feature rows all folds share, written once. A feature of a day comes from that day and earlier ones only."""
    wanted = [c for c in dict.fromkeys([train.high, train.low, train.cloud]) if c not in features.columns]
    return materialise(spark, build_features(daily, features, wanted), "base")


def split_parts(
    spark: SparkSession, daily: DataFrame, folds: DataFrame, features: FeatureSpec, train: TrainSpec
) -> tuple[DataFrame, DataFrame]:
    """`fold_parts` of folds of which every series has one."""
    models = materialise(spark, fold_models(daily, folds, features.keys, features.mean, day=features.day), "models")
    ahead = backtest_direct(daily, folds, models, features.keys, features.mean, day=features.day)
    parts = fold_parts(daily, base_rows(spark, daily, features, train), folds, models.drop("fold"), ahead, features)
    return materialise(spark, parts[0], "train"), materialise(spark, parts[1], "test")


def train_bundle(spark: SparkSession, daily: DataFrame, features: FeatureSpec, train: TrainSpec) -> Bundle:
    """Fit everything on all rows of a gap-filled daily panel."""
    forecaster = materialise(spark, select_model(daily, features.keys, features.mean, day=features.day), "forecaster")
    rows = training_rows(spark, daily, forecaster, features, train)
    columns = spark.createDataFrame([(i, c) for i, c in enumerate(features.columns)], "position int, name string")
    return Bundle(fit_models(rows, features, train), {"forecaster": forecaster, "columns": columns})


def train_if_missing(
    spark: SparkSession, path: str, daily: DataFrame, features: FeatureSpec, train: TrainSpec
) -> tuple[Bundle, bool]:
    """The saved bundle if complete and of these features, else a fresh one that is saved; and whether it trained."""
    bundle = Bundle(*load_bundle(spark, path))
    if bundle.complete:
        saved = [r["name"] for r in bundle.tables["columns"].orderBy("position").collect()]
        if saved == features.columns:
            return bundle, False
    fresh = train_bundle(spark, daily, features, train)
    save_bundle(fresh.models, fresh.tables, path)
    return fresh, True


def with_high_low(bundle: Bundle, rows: DataFrame) -> DataFrame:
    """Class, then maximum and minimum from it; rows with missing features keep NULL results."""
    scored = apply_keeping_gaps(bundle.models["classifier"], rows, "predicted_label")
    for part in ("maximum", "minimum"):
        scored = apply_keeping_gaps(bundle.models[part], scored, f"predicted_{part}")
    return scored


def or_spread(value: Column, mean: Column, offset: float) -> Column:
    """A regressor's value, or a fixed distance from the mean where it has none."""
    return F.coalesce(value, mean + F.lit(offset))

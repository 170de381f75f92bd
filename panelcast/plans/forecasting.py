"""Forecasts of the coming days for all series."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.present import describe_label, fixed_decimals
from panelcast.operators.autoreg import forecast_drivers, forecast_selected
from panelcast.operators.combine import stack
from panelcast.operators.frames import carry_forward, last_rows
from panelcast.operators.resample import trailing_profile
from panelcast.plans.features import FeatureSpec, build_features
from panelcast.plans.training import Bundle, TrainSpec, or_spread, train_if_missing, with_high_low

# Days of history kept beyond the longest lag or window.
SPARE_DAYS = 14


def future_rows(
    history: DataFrame,
    means: DataFrame,
    spec: FeatureSpec,
    horizon: int,
    drivers: list[str] | None = None,
    profile_days: int | None = None,
) -> DataFrame:
    """Base columns of the forecast days.

    The mean comes from `means`, the `drivers` are forecast, and every other
    column repeats its last value or, with `profile_days`, its trailing mean.
    """
    drivers = list(drivers or [])
    others = [c for c in spec.base if c != spec.mean and c not in drivers]
    keys = [*spec.keys, "step", spec.day]
    rows = means.select(*keys, F.col("forecast").alias(spec.mean))
    if drivers:
        ahead = forecast_drivers(history, spec.keys, drivers, horizon, spec.day)
        rows = rows.join(ahead.select(*spec.keys, "step", *drivers), [*spec.keys, "step"], "left")
    if others and profile_days is not None:
        rows = rows.join(trailing_profile(history, spec.keys, others, profile_days), spec.keys, "left")
    elif others:
        held = carry_forward(history, others, spec.keys, horizon, spec.day)
        rows = rows.join(held.select(*spec.keys, "step", *others), [*spec.keys, "step"], "left")
    return rows.select(*keys, *spec.base)


def future_features(history: DataFrame, future: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Features of the forecast days, by the same function as for history.

    Features never depend on a predicted class, maximum or minimum, so all days
    of the horizon are computed together instead of appended one by one.
    """
    depth = max([*spec.lags, *spec.windows, 1]) + SPARE_DAYS
    recent = last_rows(history, depth, spec.keys, spec.day).select(*spec.keys, spec.day, *spec.base)
    joined = stack(recent.withColumn("step", F.lit(0)), future)
    return build_features(joined, spec, ["step"]).where(F.col("step") > 0)


def forecast_days(
    history: DataFrame,
    bundle: Bundle,
    features: FeatureSpec,
    train: TrainSpec,
    horizon: int = 7,
    drivers: list[str] | None = None,
) -> DataFrame:
    """Mean, class, maximum and minimum of the coming days, typed."""
    model = bundle.tables["forecaster"]
    means = forecast_selected(history, model, features.keys, features.mean, horizon, day=features.day)
    future = future_rows(history, means, features, horizon, drivers)
    rows = future_features(history, future, features).withColumn("mean_forecast", F.col(features.mean))
    # a day without a feature is not scored: its class is unknown, its extremes lie around the mean
    scored = with_high_low(bundle, rows)
    mean = F.col("mean_forecast")
    return scored.select(
        *features.keys,
        features.day,
        "step",
        mean.alias("mean"),
        or_spread(F.col("predicted_maximum"), mean, 3.0).alias("maximum"),
        or_spread(F.col("predicted_minimum"), mean, -3.0).alias("minimum"),
        F.col("predicted_label").cast("int").alias("label"),
    ).withColumn("condition", describe_label(F.col("label")))


def forecast_report(rows: DataFrame, keys: list[str], digits: int = 1, day: str = "day") -> DataFrame:
    """The forecast as text for display."""
    return rows.select(
        *keys,
        F.date_format(day, "yyyy-MM-dd").alias("date"),
        fixed_decimals(F.col("maximum"), digits).alias("max_text"),
        fixed_decimals(F.col("minimum"), digits).alias("min_text"),
        fixed_decimals(F.col("mean"), digits).alias("avg_text"),
        "condition",
    )


def forecast_from(
    spark: SparkSession, path: str, history: DataFrame, features: FeatureSpec, train: TrainSpec, horizon: int = 7
) -> DataFrame:
    """Forecast with the bundle at `path`, training it first if a part is missing."""
    bundle, _ = train_if_missing(spark, path, history, features, train)
    return forecast_days(history, bundle, features, train, horizon)

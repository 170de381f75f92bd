"""The whole feature chain in arrays: hours to days, a centre beside its regions, calendar, lags, rolls, products, training rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelcast.functions.dates import with_calendar
from panelcast.functions.physics import dew_point
from panelcast.operators.frames import LAGS, WINDOWS
from panelcast.operators.wide import beside_regions, complete, daily_values, next_value, picked, value_names, window_arrays, window_names
from panelcast.plans.features import CALENDAR
from panelcast.schema import DAY, SERIES, daily_map


@dataclass(frozen=True)
class WideSpec:
    """What goes into the array of a day.

    variables: the hourly ones; regions: names of the slots around a centre; products and powers: pairs of daily values.
    """

    variables: list[str]
    regions: list[str]
    target: str = "temperature_2m_mean"
    dew: tuple[str, str] | None = ("temperature_2m_mean", "relative_humidity_2m_mean")
    pairs: dict[str, tuple[str, str]] = field(default_factory=dict)
    powers: list[str] = field(default_factory=list)
    lags: list[int] = field(default_factory=lambda: list(LAGS))
    windows: list[int] = field(default_factory=lambda: list(WINDOWS))

    @property
    def aggregates(self) -> dict[str, list[str]]:
        return daily_map(self.variables)

    @property
    def values(self) -> list[str]:
        return value_names(self.aggregates)

    @property
    def levels(self) -> list[str]:
        """The one main value of each variable: its mean, or its only aggregate. These are lagged and rolled."""
        return sorted(f"{name}_{hows[0]}" for name, hows in self.aggregates.items())

    @property
    def products(self) -> dict[str, tuple[str, str]]:
        """The pairs, then all products of two of `powers`; of two with one name the first is kept."""
        both = [(a, b) for i, a in enumerate(self.powers) for b in self.powers[i:]]
        return {**{f"{a}_x_{b}": (a, b) for a, b in both}, **self.pairs}

    @property
    def columns(self) -> list[str]:
        """The contract: the name of every place of `features`."""
        around = [f"{region}_{name}" for region in self.regions for name in self.values]
        dew = ["dew_point"] if self.dew else []
        return [*CALENDAR, *self.values, *around, *dew, *window_names(self.levels, self.lags, self.windows), *self.products]

    def place(self, name: str) -> int:
        return self.columns.index(name)


def wide_features(hours: DataFrame, neighbours: DataFrame, spec: WideSpec) -> DataFrame:
    """series_id, day, features (one array in the order of `spec.columns`) and target, the next day's value.

    One row per day of every series that has hours, its regions beside it: `neighbours` says which series is in which slot. Missing
    values are NULL in the array.
    """
    names = spec.values
    at = {name: i for i, name in enumerate(names)}
    days = daily_values(hours, spec.aggregates)
    met = beside_regions(days, neighbours, len(spec.regions), len(names))
    windowed = window_arrays(met, picked(F.col("values"), [at[n] for n in spec.levels]), [SERIES], DAY, spec.lags, spec.windows, len(spec.levels))

    def value(name: str) -> Column:
        return F.get("values", F.lit(at[name]))

    parts = [F.array(*[F.col(c).cast("double") for c in CALENDAR]), F.col("values"), F.col("around")]
    if spec.dew:
        parts.append(F.array(dew_point(*(value(n) for n in spec.dew))))
    parts += [F.col("lagged"), F.col("rolled"), F.col("changed")]
    if spec.products:
        parts.append(F.array(*[value(a) * value(b) for a, b in spec.products.values()]))
    rows = with_calendar(windowed).withColumn("features", F.concat(*parts))
    return rows.withColumn("target", next_value("values", at[spec.target], [SERIES])).select(SERIES, DAY, "features", "target")


def training_vectors(rows: DataFrame) -> DataFrame:
    """The rows of which every feature and the target are known, the features as a vector."""
    known = rows.where(complete("features") & F.col("target").isNotNull())
    return known.withColumn("vector", array_to_vector("features")).drop("features")


def fit_on_wide(vectors: DataFrame, stages: list) -> PipelineModel:
    """A scaler and the given stages, which read `scaled`. The vectors are assembled already, so no stage lists the columns."""
    scaler = StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True)
    return Pipeline(stages=[scaler, *stages]).fit(vectors)

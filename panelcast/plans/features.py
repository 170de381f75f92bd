"""One feature function for training, evaluation and forecasts."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelcast.functions.dates import SEASON_FLAGS, with_calendar
from panelcast.functions.physics import dew_point, interactions, polynomial
from panelcast.operators.frames import LAGS, STATISTICS, WINDOWS, window_features
from panelcast.schema import unique_names

CALENDAR = [
    "day_of_week",
    "month",
    "day_of_year",
    "week_of_year",
    *[f"season_{s}" for s in SEASON_FLAGS],
    "month_sin",
    "month_cos",
    "day_of_week_sin",
    "day_of_week_cos",
]


@dataclass(frozen=True)
class FeatureSpec:
    """Names of a daily panel's columns and of what is derived from them."""

    keys: list[str]
    mean: str
    base: list[str]
    day: str = "day"
    dew: tuple[str, str] | None = None
    pairs: dict[str, tuple[str, str]] = field(default_factory=dict)
    poly: list[str] = field(default_factory=list)
    lags: list[int] = field(default_factory=lambda: list(LAGS))
    windows: list[int] = field(default_factory=lambda: list(WINDOWS))
    full_windows: bool = False

    @property
    def levels(self) -> list[str]:
        """Columns that are lagged and rolled."""
        return [*self.base, "dew_point"] if self.dew else list(self.base)

    @property
    def columns(self) -> list[str]:
        """The contract: every feature in order."""
        derived = [f"{c}_lag_{k}" for c in self.levels for k in self.lags]
        derived += [f"{c}_rolling_{s}_{w}d" for c in self.levels for w in self.windows for s in STATISTICS]
        derived += [f"{c}_diff_1d" for c in self.levels]
        powers = [n for n in polynomial(self.poly) if n not in self.poly]
        return unique_names([*CALENDAR, *self.levels, *derived, *self.pairs, *powers])


def build_features(df: DataFrame, spec: FeatureSpec, keep: list[str] | None = None) -> DataFrame:
    """Keys, day, `keep` and all features of a daily panel, one row per day in and out."""
    rows = with_calendar(df, spec.day)
    if spec.dew:
        rows = rows.withColumn("dew_point", dew_point(F.col(spec.dew[0]), F.col(spec.dew[1])))
    rows = window_features(rows, spec.levels, spec.keys, spec.day, spec.lags, spec.windows, full=spec.full_windows)
    # of two products with one name the first is kept
    made = {**{n: e for n, e in polynomial(spec.poly).items() if n not in spec.poly}, **interactions(spec.pairs)}
    rows = rows.withColumns(made) if made else rows
    # a deviation over fewer than two known days has no value; it counts as no spread
    spread = [c for c in spec.columns if "_rolling_std_" in c and not spec.full_windows]
    rows = rows.fillna(0.0, subset=spread) if spread else rows
    held = [c for c in (keep or []) if c not in spec.columns]
    return rows.select(*spec.keys, spec.day, *held, *spec.columns)

"""Calendar columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Months of each season; every other month is Winter.
SEASON_MONTHS = {"Spring": [3, 4], "Summer": [5, 6], "Monsoon": [7, 8, 9]}
DEFAULT_SEASON = "Winter"
# The alphabetically first category (Monsoon) is the base and gets no flag.
SEASON_FLAGS = ["Spring", "Summer", "Winter"]


def calendar_parts(day: Column) -> dict[str, Column]:
    """Weekday (Monday is 0), month, day of year and ISO week."""
    return {
        "day_of_week": F.weekday(day),
        "month": F.month(day),
        "day_of_year": F.dayofyear(day),
        "week_of_year": F.weekofyear(day),
    }


def season(month: Column, months: dict[str, list[int]] = SEASON_MONTHS, default: str = DEFAULT_SEASON) -> Column:
    chosen = F.lit(default)
    for name, members in months.items():
        chosen = F.when(month.isin(members), F.lit(name)).otherwise(chosen)
    return chosen


def one_hot(value: Column, categories: list[str], prefix: str) -> dict[str, Column]:
    """0/1 per listed category; the list is fixed so that a single row has all columns."""
    return {f"{prefix}_{c}": F.when(value == c, 1).otherwise(0) for c in categories}


def cyclic(value: Column, period: float, name: str) -> dict[str, Column]:
    angle = value * F.lit(2 * math.pi / period)
    return {f"{name}_sin": F.sin(angle), f"{name}_cos": F.cos(angle)}


def with_calendar(df: DataFrame, day: str = "day") -> DataFrame:
    """All calendar features of a day, in one projection."""
    parts = calendar_parts(F.col(day))
    columns = dict(parts)
    columns.update(one_hot(season(parts["month"]), SEASON_FLAGS, "season"))
    columns.update(cyclic(parts["month"], 12, "month"))
    columns.update(cyclic(parts["day_of_week"], 7, "day_of_week"))
    return df.withColumns(columns)


def parse_local(text: Column) -> Column:
    """ISO text as local timestamp without zone, untouched by the session's zone; unreadable text gives NULL."""
    return text.try_cast("timestamp_ntz")


def iso_minutes(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm")

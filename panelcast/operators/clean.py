"""Missing values, column contracts and simple filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Non-missing count of every column in one pass, one output row per column."""
    counts = df.agg(*[F.count(c).alias(c) for c in columns])
    return counts.unpivot([], columns, "column_name", "non_null")


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold no value at all (one counting pass decides)."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def align(df: DataFrame, contract: dict[str, str], keep: list[str] | None = None, fill: float = 0) -> DataFrame:
    """The key columns, then those of the contract in its order and types.

    An absent or missing value becomes `fill`; columns outside the contract go.
    """
    columns = [
        (F.coalesce(F.col(c), F.lit(fill)) if c in df.columns else F.lit(fill)).cast(kind).alias(c)
        for c, kind in contract.items()
    ]
    return df.select(*(keep or []), *columns)


def to_number(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as double, unreadable values as NULL."""
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns})


def fill_mean(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Missing values take the mean of their series.

    The means come from a grouped aggregate joined back, so a very long series
    is never gathered in one window.
    """
    means = df.groupBy(*keys).agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    joined = df.join(means, keys, "left")
    return joined.select(*[F.coalesce(c, F.col(f"_{c}")).alias(c) if c in columns else F.col(c) for c in df.columns])


def with_prefix(df: DataFrame, prefixes: list[str], keep: list[str]) -> DataFrame:
    names = [c for c in df.columns if c not in keep and any(c.startswith(p) for p in prefixes)]
    return df.select(*keep, *names)


def is_recent(keys: list[str], days: int, day: str = "day") -> Column:
    """Whether a daily row is not older than `days` before the last day of its series.

    A window over daily rows reads the input once, and aggregates by series
    after it need no further exchange.
    """
    return F.col(day) >= F.date_sub(F.max(day).over(W.partitionBy(*keys)), days)


def trailing_days(df: DataFrame, keys: list[str], days: int, day: str = "day") -> DataFrame:
    """The daily rows of the last `days` before the last day of each series."""
    return df.withColumn("_recent", is_recent(keys, days, day)).where("_recent").drop("_recent")


def before(df: DataFrame, cutoff: Column, day: str = "day") -> DataFrame:
    """History known when a day is forecast: strictly before it."""
    return df.where(F.col(day) < cutoff)


def when_complete(columns: list[str], value: Column) -> Column:
    """`value` where all listed columns are known, else NULL."""
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return F.when(known, value)

"""Read plans: month chunks of a date range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def month_chunks(df: DataFrame, start: str, end: str, keep: list[str], clamp_start: bool = True) -> DataFrame:
    """One row per calendar month of `start`..`end`, clamped to the range.

    `clamp_start=False` begins the first chunk on the first of the month.
    """
    months = F.sequence(F.trunc(start, "MM"), F.col(end), F.expr("interval 1 month"))
    rows = df.select(*keep, start, end, F.explode(months).alias("_first"))
    begin = F.greatest(F.col("_first"), F.col(start)) if clamp_start else F.col("_first")
    return rows.select(
        *keep,
        begin.alias("chunk_start"),
        F.least(F.last_day("_first"), F.col(end)).alias("chunk_end"),
        F.date_format("_first", "MMMM").alias("month_name"),
    )


def is_short_period(start: Column, end: Column) -> Column:
    """Same month, or fewer days apart than the start month has."""
    same_month = F.trunc(start, "MM") == F.trunc(end, "MM")
    return same_month | (F.date_diff(end, start) < F.dayofmonth(F.last_day(start)))

"""Table scans by column list, time range and series."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.schema import unique_names


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet") -> DataFrame:
    df = spark.read.format(fmt).load(path)
    return select_ordered(df, columns) if columns else df


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    columns: list[str],
    split_column: str,
    lower: str,
    upper: str,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Relational source read in parallel ranges of one column; filters put on it are pushed down."""
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=table,
        partitionColumn=split_column,
        lowerBound=lower,
        upperBound=upper,
        numPartitions=str(partitions),
        **options,
    )
    return select_ordered(reader.load(), columns)


def select_ordered(df: DataFrame, names: list[str]) -> DataFrame:
    """Columns in contract order, first occurrence only, absent ones left out."""
    return df.select([c for c in unique_names(names) if c in df.columns])


def in_range(ts: Column, start: date, end: date, inclusive_end: bool = False) -> Column:
    """`start` to `end` as whole days; `inclusive_end` also admits the midnight after `end`."""
    low = F.lit(start).cast("timestamp_ntz")
    high = F.lit(end + timedelta(days=1)).cast("timestamp_ntz")
    return (ts >= low) & ((ts <= high) if inclusive_end else (ts < high))


def scan(
    df: DataFrame,
    columns: list[str],
    start: date | None = None,
    end: date | None = None,
    ts: str = "ts",
    series: str | None = None,
    series_col: str = "series_id",
    inclusive_end: bool = False,
) -> DataFrame:
    """Projection with an optional day range and an optional series; both reach the file scan."""
    if start is not None and end is not None:
        df = df.where(in_range(F.col(ts), start, end, inclusive_end))
    if series is not None:
        df = df.where(F.col(series_col) == series)
    return select_ordered(df, columns)


def prefix_bounds(prefix: str) -> tuple[date, date]:
    """First and last day of a `yyyy`, `yyyy-MM` or `yyyy-MM-dd` prefix; a closing `-` or `%` is ignored."""
    found = re.fullmatch(r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", prefix.rstrip("%").rstrip("-"))
    if not found:
        raise ValueError(f"not a date prefix: {prefix!r}")
    year, month, day = (int(g) if g else None for g in found.groups())
    if month is None:
        return date(year, 1, 1), date(year, 12, 31)
    if day is not None:
        return date(year, month, day), date(year, month, day)
    following = date(year + month // 12, month % 12 + 1, 1)
    return date(year, month, 1), following - timedelta(days=1)


def like_prefix(ts: Column, prefix: str) -> Column:
    """`ts::text LIKE 'yyyy-MM-%'` as a range, so that files and partitions can be pruned."""
    return in_range(ts, *prefix_bounds(prefix))


def covers(df: DataFrame, keys: list[str], ts: str, start: date, end: date) -> DataFrame:
    """Keys whose first day is not after `start` and whose last day is not before `end`."""
    ends = df.groupBy(*keys).agg(F.min(F.to_date(ts)).alias("first_day"), F.max(F.to_date(ts)).alias("last_day"))
    return ends.where((F.col("first_day") <= F.lit(start)) & (F.col("last_day") >= F.lit(end)))


def covered_rows(df: DataFrame, keys: list[str], ts: str, start: date, end: date) -> DataFrame:
    """Only the rows of series that cover the whole range."""
    return df.join(covers(df, keys, ts, start, end).select(*keys), keys, "left_semi")

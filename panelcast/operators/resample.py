"""Hour to day: per-variable aggregates, gap days, positional chunks, day profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.operators.clean import is_recent, trailing_days
from panelcast.schema import DAY, SERIES, TS

KNOWN = ("mean", "min", "max", "sum", "first", "last")


def aggregate(name: str, how: str, order: Column) -> Column:
    """One aggregate over the known values; a sum without any is 0, the others are NULL."""
    value = F.col(name)
    if how == "mean":
        return F.avg(value.cast("double"))
    if how == "min":
        return F.min(value)
    if how == "max":
        return F.max(value)
    if how == "sum":
        return F.coalesce(F.sum(value.cast("double")), F.lit(0.0))
    # the order is NULL beside a missing value, and such rows are skipped
    known_order = F.when(value.isNotNull(), order)
    if how == "first":
        return F.min_by(value, known_order)
    if how == "last":
        return F.max_by(value, known_order)
    raise ValueError(f"{how!r} is none of {KNOWN}")


def daily(
    df: DataFrame,
    spec: dict[str, list[str]],
    keys: list[str] | None = None,
    ts: str = TS,
    tie: list[str] | None = None,
    prefix: str = "",
) -> DataFrame:
    """Calendar-day aggregate by series: `{prefix}{variable}_{aggregate}` columns."""
    # a plain time keeps the aggregate hash-based; only ties between equal times need more
    order = F.struct(ts, *tie) if tie else F.col(ts)
    terms = [
        aggregate(name, how, order).alias(f"{prefix}{name}_{how}")
        for name, hows in spec.items()
        if name in df.columns
        for how in hows
    ]
    return df.groupBy(*(keys or [SERIES]), F.to_date(ts).alias(DAY)).agg(*terms)


def day_span(df: DataFrame, keys: list[str], day: str = DAY) -> DataFrame:
    """First and last day of each series."""
    return df.groupBy(*keys).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"))


def fill_gaps(df: DataFrame, keys: list[str], day: str = DAY) -> DataFrame:
    """Every calendar day between the first and last day of a series; new days hold NULL.

    Expects one row per series and day. Each row is spread over the days up to
    the next one, so the input is read once and stays partitioned by series.
    """
    following = F.lead(day).over(W.partitionBy(*keys).orderBy(day))
    until = F.coalesce(F.date_sub(following, 1), F.col(day))
    spread = df.withColumn("_until", until).withColumn("_day", F.explode(F.sequence(F.col(day), F.col("_until"))))
    return spread.select(
        *[
            F.col("_day").alias(day) if c == day else F.col(c) if c in keys else F.when(F.col("_day") == F.col(day), F.col(c)).alias(c)
            for c in df.columns
        ]
    )


def daily_mean(df: DataFrame, value: str, keys: list[str] | None = None, ts: str = TS) -> DataFrame:
    """Daily mean of one variable; days without any value are left out."""
    keys = keys or [SERIES]
    means = df.groupBy(*keys, F.to_date(ts).alias(DAY)).agg(F.avg(F.col(value).cast("double")).alias("y"))
    return means.where(F.col("y").isNotNull())


def position(df: DataFrame, keys: list[str], order: list[str], bucket: Column) -> DataFrame:
    """Row position from 0 within a series, as `pos`.

    Rows are numbered within a time bucket and shifted by the number of rows in
    earlier buckets, so no task holds a whole series. `bucket` must rise with
    the first of `order` and hold a bounded number of rows, as a day of a table
    with one row per series and hour does.
    """
    placed = df.withColumn("_bucket", bucket)
    sizes = placed.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order))
    numbered = placed.withColumn("_inside", inside).join(offsets, [*keys, "_bucket"])
    return numbered.withColumn("pos", F.col("_offset") + F.col("_inside") - 1).drop("_bucket", "_offset", "_inside")


def chunks_of(
    df: DataFrame, spec: dict[str, list[str]], size: int = 24, keys: list[str] | None = None, ts: str = TS
) -> DataFrame:
    """Positional chunks of `size` rows instead of calendar days; an incomplete last chunk is dropped."""
    keys = keys or [SERIES]
    placed = position(df, keys, [ts], F.to_date(ts))
    placed = placed.withColumn("chunk", F.floor(F.col("pos") / size))
    terms = [aggregate(n, how, F.col(ts)).alias(f"{n}_{how}") for n, hows in spec.items() for how in hows]
    grouped = placed.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("_n"), F.min(ts).alias("chunk_start"), *terms)
    return grouped.where(F.col("_n") == size).drop("_n")


def diurnal_offsets(
    df: DataFrame, keys: list[str], mean: str, high: str, low: str, days: int = 365, default: float = 5.0
) -> DataFrame:
    """Mean of (max - mean) and (mean - min) over the trailing days of daily rows."""
    recent = df.withColumn("_recent", is_recent(keys, days))
    spread = {"up": F.col(high) - F.col(mean), "down": F.col(mean) - F.col(low)}
    # a series without a known spread in these days still has a row, with the default
    return recent.groupBy(*keys).agg(
        *[F.coalesce(F.avg(F.when(F.col("_recent"), e)), F.lit(default)).alias(n) for n, e in spread.items()]
    )


def trailing_profile(df: DataFrame, keys: list[str], columns: list[str], days: int = 30) -> DataFrame:
    """Mean of every column over the trailing days of each series."""
    return trailing_days(df, keys, days).groupBy(*keys).agg(*[F.avg(c).alias(c) for c in columns])

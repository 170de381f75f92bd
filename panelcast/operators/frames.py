"""Row-frame features per series: lags, rolling statistics, differences, leads, tails.

Every window here is partitioned by series and ordered by day and runs on
daily rows. A series has one row per day, so a partition is as long as the
calendar however many raw observations a series holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The lags, window lengths and statistics of the default feature set.
LAGS = [1, 2, 3, 7, 14, 30]
WINDOWS = [3, 7]
STATISTICS = ["mean", "min", "max", "std"]

_FUNCTIONS = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp}


def by_day(keys: list[str], day: str = "day"):
    return W.partitionBy(*keys).orderBy(day)


def lag_columns(names: list[str], spec, lags: list[int] = LAGS) -> dict[str, Column]:
    return {f"{n}_lag_{k}": F.lag(n, k).over(spec) for n in names for k in lags}


def rolling_columns(
    names: list[str],
    spec,
    windows: list[int] = WINDOWS,
    statistics: list[str] = STATISTICS,
    full: bool = True,
) -> dict[str, Column]:
    """Statistics of the last w rows; with `full` they are NULL until all w values are known."""
    out: dict[str, Column] = {}
    for n in names:
        for w in windows:
            frame = spec.rowsBetween(-(w - 1), 0)
            for s in statistics:
                value = _FUNCTIONS[s](n).over(frame)
                if full:
                    value = F.when(F.count(n).over(frame) == w, value)
                out[f"{n}_rolling_{s}_{w}d"] = value
    return out


def difference_columns(names: list[str], spec) -> dict[str, Column]:
    return {f"{n}_diff_1d": F.col(n) - F.lag(n, 1).over(spec) for n in names}


def window_features(
    df: DataFrame,
    names: list[str],
    keys: list[str],
    day: str = "day",
    lags: list[int] = LAGS,
    windows: list[int] = WINDOWS,
    statistics: list[str] = STATISTICS,
    full: bool = True,
    difference: bool = True,
) -> DataFrame:
    """All row-frame features in one projection: one exchange and one sort serve them all."""
    spec = by_day(keys, day)
    columns = lag_columns(names, spec, lags)
    columns.update(rolling_columns(names, spec, windows, statistics, full))
    if difference:
        columns.update(difference_columns(names, spec))
    return df.withColumns(columns)


def next_day(df: DataFrame, targets: dict[str, str], keys: list[str], day: str = "day", steps: int = 1) -> DataFrame:
    """Target columns: the value `steps` rows later."""
    spec = by_day(keys, day)
    return df.withColumns({name: F.lead(source, steps).over(spec) for name, source in targets.items()})


def last_rows(df: DataFrame, n: int, keys: list[str], day: str = "day") -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.col(day).desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def carry_gaps(df: DataFrame, names: list[str], keys: list[str], day: str = "day") -> DataFrame:
    """Missing values take the last known one before them."""
    spec = by_day(keys, day).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({n: F.last(n, ignorenulls=True).over(spec) for n in names})


def future_days(df: DataFrame, keys: list[str], horizon: int, day: str = "day") -> DataFrame:
    """The `horizon` days after the last day of each series, with the step number."""
    last = df.groupBy(*keys).agg(F.max(day).alias("_last"))
    steps = last.select(*keys, "_last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(*keys, "step", F.date_add("_last", F.col("step")).alias(day))


def carry_forward(df: DataFrame, names: list[str], keys: list[str], horizon: int, day: str = "day") -> DataFrame:
    """Future days that repeat the last known value of each column."""
    last = df.groupBy(*keys).agg(
        F.max(day).alias("_last"),
        *[F.max_by(n, F.when(F.col(n).isNotNull(), F.col(day))).alias(n) for n in names],
    )
    steps = last.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(*keys, "step", F.date_add("_last", F.col("step")).alias(day), *names)


def numbered(df: DataFrame, keys: list[str], day: str = "day", name: str = "pos") -> DataFrame:
    """Position of a day within its series, from 0."""
    return df.withColumn(name, F.row_number().over(by_day(keys, day)) - 1)


def slice_rows(df: DataFrame, keys: list[str], start: int, stop: int, day: str = "day") -> DataFrame:
    """Rows `start` (from 0) up to but not including `stop` of each series."""
    return numbered(df, keys, day).where((F.col("pos") >= start) & (F.col("pos") < stop))


def best_candidate(df: DataFrame, keys: list[str], candidate: str, score: str) -> DataFrame:
    """The candidate of the highest score; the smaller one wins a tie."""
    ranked = F.struct(F.col(score), -F.col(candidate))
    known = F.when(F.col(score).isNotNull(), ranked)
    grouped = df.groupBy(*keys) if keys else df.groupBy()
    return grouped.agg(F.max_by(candidate, known).alias(candidate), F.max(score).alias(score))

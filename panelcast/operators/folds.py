"""Walk-forward folds by date, chronological splits, and back-tests over folds.

Positions count calendar days from the first day of a series, so that every
model of a fold is tested on the same dates. `test_end` and `train_end` are
inclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.operators.autoreg import first_order_path, with_lags
from panelcast.operators.frames import numbered
from panelcast.operators.resample import day_span


def spread_folds(spans: DataFrame, keys: list[str], count: Column, test_start: Column, test_end: Column) -> DataFrame:
    """One row per fold number 0..count-1; the positions may use the column `fold`.

    `test_end` is the position after the last test day.
    """
    numbers = F.filter(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: i < count)
    rows = spans.select("*", F.explode(numbers).alias("fold"))
    first = F.col("first_day")
    return rows.select(
        *keys,
        (F.col("fold") + 1).cast("int").alias("fold"),
        first.alias("train_start"),
        F.date_add(first, (test_start - 1).cast("int")).alias("train_end"),
        F.date_add(first, test_start.cast("int")).alias("test_start"),
        F.date_add(first, (test_end - 1).cast("int")).alias("test_end"),
    )


def total_days() -> Column:
    return F.date_diff("last_day", "first_day") + 1


def folds_last(spans: DataFrame, keys: list[str], folds: int = 10, test_days: int = 30, train_days: int = 365) -> DataFrame:
    """Up to `folds` windows at the end of a series, each trained on at least `train_days`."""
    total = total_days()
    start = F.greatest(F.lit(train_days), total - folds * test_days)
    begin = start + F.col("fold") * test_days
    end = F.least(begin + test_days, total)
    # a fold exists when at least one test day is left for it
    count = F.least(F.lit(folds), F.ceil((total - start) / test_days))
    return spread_folds(spans, keys, count.cast("int"), begin, end)


def folds_every(spans: DataFrame, keys: list[str], test_days: int = 60, train_days: int = 365) -> DataFrame:
    """All full windows of `test_days` after the first `train_days`."""
    total = total_days()
    begin = F.lit(train_days) + F.col("fold") * test_days
    count = F.floor((total - train_days) / test_days)
    return spread_folds(spans, keys, count.cast("int"), begin, begin + test_days)


def folds_or_split(
    spans: DataFrame,
    keys: list[str],
    folds: int = 10,
    test_days: int = 30,
    train_days: int = 730,
    train_share: float = 0.8,
) -> DataFrame:
    """Up to `folds` last windows with `train_days` before them; a shorter series is split once by share."""
    total = total_days()
    enough = total >= train_days + test_days
    many = F.least(F.lit(folds), F.floor((total - train_days) / test_days))
    cut = F.floor(total * F.lit(train_share))
    split = F.when((cut > 0) & (cut < total), 1).otherwise(0)
    begin = F.when(enough, total - (many - F.col("fold")) * test_days).otherwise(cut)
    end = F.when(enough, F.least(begin + test_days, total)).otherwise(total)
    return spread_folds(spans, keys, F.when(enough, many).otherwise(split).cast("int"), begin, end)


def chronological_split(df: DataFrame, keys: list[str], share: float = 0.8, day: str = "day") -> DataFrame:
    """`part` is train for the first `share` of the rows of a series, else test."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(df, keys, day, "_pos").join(sizes, keys)
    part = F.when(F.col("_pos") < F.floor(F.col("_n") * F.lit(share)), "train").otherwise("test")
    return placed.withColumn("part", part).drop("_pos", "_n")


def fold_rows(df: DataFrame, folds: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Test rows with their fold; folds of a series do not overlap, so a row has one fold at most.

    Every fold is spread to its days, which makes the join an equality.
    """
    days = folds.select(*keys, "fold", F.explode(F.sequence("test_start", "test_end")).alias(day))
    return df.join(days, [*keys, day])


def backtest_first_order(
    df: DataFrame, folds: DataFrame, keys: list[str], y: str, day: str = "day", name: str = "forecast"
) -> DataFrame:
    """Direct multi-step AR(1) back-test: fit up to `train_end`, forecast every test day.

    Training windows grow from fold to fold. Each row is counted once, in the
    first fold that trains on it, and the fits come from running totals over
    the folds rather than from a copy of the history per fold.
    """
    pairs = with_lags(df, y, [1], keys, day)
    # the folds of a series, a bounded list, decide which fold uses a row first
    ends = folds.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("train_end", "fold"))).alias("_ends"))
    marked = pairs.join(ends, keys)
    later = F.filter("_ends", lambda e: e["train_end"] >= F.col(day))
    marked = marked.withColumn("fold", F.get(later, F.lit(0))["fold"]).where(F.col("fold").isNotNull())
    a, b = F.col("_lag_1"), F.col(y)
    pair = a.isNotNull() & b.isNotNull()
    sums = marked.groupBy(*keys, "fold").agg(
        F.sum(F.when(pair, 1).otherwise(0)).alias("n"),
        F.coalesce(F.sum(F.when(pair, a)), F.lit(0.0)).alias("sx"),
        F.coalesce(F.sum(F.when(pair, b)), F.lit(0.0)).alias("sy"),
        F.coalesce(F.sum(F.when(pair, a * a)), F.lit(0.0)).alias("sxx"),
        F.coalesce(F.sum(F.when(pair, a * b)), F.lit(0.0)).alias("sxy"),
        F.max(F.when(b.isNotNull(), F.struct(day, y))).alias("_last"),
    )
    # a fold that adds no training rows still needs its running totals
    sums = folds.select(*keys, "fold").join(sums, [*keys, "fold"], "left")
    running = W.partitionBy(*keys).orderBy("fold").rowsBetween(W.unboundedPreceding, 0)
    totals = sums.select(
        *keys,
        "fold",
        *[F.sum(c).over(running).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy")],
        F.last("_last", ignorenulls=True).over(running).alias("_last"),
    )
    spread = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    phi = F.when(spread > 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / spread)
    fits = totals.withColumn("_phi", phi).withColumn("_intercept", (F.col("sy") - F.col("_phi") * F.col("sx")) / F.col("n"))
    fits = fits.select(*keys, "fold", "_phi", "_intercept", "_last")
    tested = fold_rows(df, folds, keys, day).join(fits, [*keys, "fold"])
    step = F.date_diff(F.col(day), F.col("_last")[day])
    value = first_order_path(F.col("_intercept"), F.col("_phi"), F.col("_last")[y], step)
    return tested.withColumn(name, value).drop("_phi", "_intercept", "_last")


def spans_of(df: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    return day_span(df, keys, day)

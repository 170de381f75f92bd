"""One autoregressive model per series and fold, and back-tests that see nothing after the fold's last training day.

Training windows of a series grow from fold to fold. Each row is counted once, in the first fold that trains on it;
running totals over the folds give the sums of every fold, so no history is copied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.operators.autoreg import LAG_SETS, UNIT_ROOT_BOUND, all_lags, chosen_sets, forecast_path, packed_sums, products, with_lags
from panelcast.operators.folds import fold_rows
from panelcast.operators.frames import by_day, carry_gaps


def first_trained(df: DataFrame, folds: DataFrame, keys: list[str], day: str = "day") -> DataFrame:
    """Adds `fold`: the first fold that trains on the row; rows after the last training day go.

    The ends of the folds stand among the rows of their series; backwards in time, the last end that was passed is the row's.
    """
    marks = folds.select(*keys, F.col("train_end").alias(day), F.col("fold").cast("int").alias("_mark"), F.lit(0).alias("_row"))
    rows = df.withColumns({"_mark": F.lit(None).cast("int"), "_row": F.lit(1)}).unionByName(marks, allowMissingColumns=True)
    backwards = W.partitionBy(*keys).orderBy(F.col(day).desc(), "_row").rowsBetween(W.unboundedPreceding, 0)
    placed = rows.withColumn("fold", F.last("_mark", ignorenulls=True).over(backwards))
    return placed.where((F.col("_row") == 1) & F.col("fold").isNotNull()).drop("_mark", "_row")


def running_totals(sums: DataFrame, folds: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Per fold the totals of all folds up to it; a fold that adds no row has those of the one before."""
    own = [k for k in keys if k not in folds.columns]
    every = folds.select(*[k for k in keys if k in folds.columns], "fold")
    if own:
        every = every.join(sums.select(*keys).distinct(), [k for k in keys if k in folds.columns])
    spec = W.partitionBy(*keys).orderBy("fold").rowsBetween(W.unboundedPreceding, 0)
    joined = every.join(sums, [*keys, "fold"], "left")
    return joined.select(*keys, "fold", *[F.coalesce(F.sum(c).over(spec), F.lit(0.0)).alias(c) for c in columns])


def fold_orders(df: DataFrame, folds: DataFrame, keys: list[str], y: str, day: str = "day", bound: float = UNIT_ROOT_BOUND) -> DataFrame:
    """`d` per series and fold by the Dickey-Fuller t of its training days (see `difference_order`)."""
    pairs = with_lags(df, y, [1], keys, day).withColumn("_c", F.col(y) - F.col("_lag_1")).withColumnRenamed("_lag_1", "_x")
    terms = {"n": F.lit(1.0), "sx": F.col("_x"), "sc": F.col("_c"), "sxx": F.col("_x") * F.col("_x"), "sxc": F.col("_x") * F.col("_c"), "scc": F.col("_c") * F.col("_c")}
    known = first_trained(pairs.where(F.col("_c").isNotNull()), folds, keys, day)
    sums = known.groupBy(*keys, "fold").agg(*[F.sum(e.cast("double")).alias(c) for c, e in terms.items()])
    total = running_totals(sums, folds, keys, list(terms))
    n = F.col("n")
    spread = {name: F.col(f"s{name}") - F.try_divide(F.col(f"s{name[0]}") * F.col(f"s{name[1]}"), n) for name in ("xx", "xc", "cc")}
    slope = F.try_divide(spread["xc"], F.when(spread["xx"] > 0, spread["xx"]))
    residual = spread["cc"] - slope * spread["xc"]
    residual = F.when(residual > spread["cc"] * 1e-12, residual)
    error = F.sqrt(F.try_divide(F.try_divide(residual, n - 2), spread["xx"]))
    t = F.when(n > 2, F.try_divide(slope, error))
    return total.select(*keys, "fold", F.when(t > bound, 1).otherwise(0).alias("d"))


def fold_models(
    df: DataFrame,
    folds: DataFrame,
    keys: list[str],
    y: str,
    candidates: list[list[int]] | None = None,
    day: str = "day",
    difference: bool = True,
) -> DataFrame:
    """The model of each series and fold from its days up to `train_end`: keys, fold, d, n, lags, coefficients, rss, aic.

    Differencing by the unit-root test and the lag set by AIC, both on the training days alone. Without `difference` levels
    are modelled. Values and their changes are two series of one longer panel, so one pass serves both.
    """
    sets = candidates or LAG_SETS
    widest = all_lags(sets)
    value = F.col(y).cast("double")
    change = value - F.lag(value, 1).over(by_day(keys, day))
    kinds = [F.struct(F.lit(0).alias("d"), value.alias("_v")), F.struct(F.lit(1).alias("d"), F.col("_change").alias("_v"))]
    both = df.select(*keys, day, y, change.alias("_change")).select(*keys, day, F.inline(F.array(*kinds[: 2 if difference else 1])))
    own = [*keys, "d"]
    terms = [f"_lag_{k}" for k in widest]
    lagged = first_trained(with_lags(both, "_v", widest, own, day).dropna(subset=["_v", *terms]), folds, keys, day)
    added = {"n": F.lit(1.0), **products("_v", terms)}
    sums = lagged.groupBy(*own, "fold").agg(*[F.sum(e).alias(c) for c, e in added.items()])
    total = running_totals(sums, folds, own, list(added)).withColumn("n", F.col("n").cast("long"))
    chosen = chosen_sets(packed_sums(total, [*own, "fold"], terms), [*own, "fold"], sets)
    if not difference:
        orders = folds.select(*keys, "fold", F.lit(0).alias("d"))
    else:
        orders = fold_orders(df, folds, keys, y, day)
    # a fold too short for any lag set keeps its row, without coefficients
    return orders.join(chosen, [*own, "fold"], "left").fillna(0, ["n"])


def _lag_values(df: DataFrame, keys: list[str], y: str, lags: list[int], day: str) -> DataFrame:
    """Adds `_levels` and `_changes`, the lags of the values and of their changes, a missing one as the last known; `_before`, the last value."""
    spec = by_day(keys, day)
    earlier = spec.rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("_l", F.col(y).cast("double"))
    rows = rows.withColumn("_c", F.col("_l") - F.lag("_l", 1).over(spec))

    def packed(name: str) -> Column:
        last = F.last(name, ignorenulls=True).over(earlier)
        return F.array(*[F.coalesce(F.lag(name, k).over(spec), last) for k in lags])

    before = F.last("_l", ignorenulls=True).over(earlier)
    return rows.select(*df.columns, packed("_l").alias("_levels"), packed("_c").alias("_changes"), before.alias("_before"))


def one_step(rows: DataFrame, lags: list[int]) -> Column:
    """The value that `coefficients` give from the lags of the row; the last value where there is no model."""
    now = F.when(F.col("d") == 1, F.col("_changes")).otherwise(F.col("_levels"))
    value = F.element_at("coefficients", 1)
    for i in range(len(lags)):
        value = value + F.element_at("coefficients", 2 + i) * F.get(now, F.lit(i))
    value = F.when(F.col("d") == 1, value + F.col("_before")).otherwise(value)
    return F.coalesce(value, F.col("_before"))


def backtest_frozen(
    df: DataFrame,
    folds: DataFrame,
    models: DataFrame,
    keys: list[str],
    y: str,
    candidates: list[list[int]] | None = None,
    day: str = "day",
    name: str = "forecast",
) -> DataFrame:
    """Test rows with one-step forecasts: the coefficients of the fold stay, the state is renewed with every day.

    The lags of a day are the true values before it, so all days of a fold come out of one pass.
    """
    lags = all_lags(candidates or LAG_SETS)
    rows = _lag_values(df, keys, y, lags, day)
    tested = fold_rows(rows, folds, keys, day).join(models.select(*keys, "fold", "d", "coefficients"), [*keys, "fold"], "left")
    return tested.withColumn(name, one_step(tested, lags)).select(*df.columns, "fold", name)


def backtest_direct(
    df: DataFrame,
    folds: DataFrame,
    models: DataFrame,
    keys: list[str],
    y: str,
    candidates: list[list[int]] | None = None,
    day: str = "day",
    name: str = "forecast",
) -> DataFrame:
    """Test rows with forecasts of many steps: nothing after the fold's last training day is seen.

    The state of a fold are the last values up to `train_end`, gaps carried forward; the panel has every calendar day. Changes
    are forecast for a fold with d = 1 and added up from the last value.
    """
    lags = all_lags(candidates or LAG_SETS)
    depth = max([1, *lags]) + 1
    carried = carry_gaps(df.select(*keys, day, F.col(y).cast("double").alias("_v")), ["_v"], keys, day)
    wanted = folds.select(*keys, "fold", F.explode(F.sequence(F.date_sub("train_end", depth - 1), F.col("train_end"))).alias(day))
    state = carried.join(wanted, [*keys, day]).groupBy(*keys, "fold")
    state = state.agg(F.transform(F.array_sort(F.collect_list(F.struct(day, "_v"))), lambda e: e["_v"]).alias("_levels"))
    state = state.join(models.select(*keys, "fold", "d", "coefficients"), [*keys, "fold"], "left")
    state = state.join(folds.select(*keys, "fold", "train_end", "test_end"), [*keys, "fold"])
    size = F.size("_levels")
    changes = F.zip_with(F.slice("_levels", F.lit(2), F.greatest(size - 1, F.lit(0))), F.slice("_levels", F.lit(1), F.greatest(size - 1, F.lit(0))), lambda b, a: b - a)
    last = F.element_at("_levels", -1)
    state = state.withColumn("_last", last).withColumn("_state", F.when(F.col("d") == 1, changes).otherwise(F.col("_levels")))
    ahead = F.date_diff("test_end", "train_end")
    state = state.withColumn("_path", forecast_path(F.col("coefficients"), lags, F.col("_state"), ahead))
    steps = state.select(*keys, "fold", "d", "_last", "train_end", "coefficients", F.posexplode("_path").alias("_i", "_f"))
    total = F.sum("_f").over(W.partitionBy(*keys, "fold").orderBy("_i"))
    value = F.when(F.col("coefficients").isNull(), F.col("_last")).when(F.col("d") == 1, F.col("_last") + total).otherwise(F.col("_f"))
    made = steps.select(*keys, "fold", F.date_add("train_end", F.col("_i") + 1).alias(day), value.alias(name))
    return fold_rows(df, folds, keys, day).join(made, [*keys, "fold", day], "left").select(*df.columns, "fold", name)


def fitted_in_fold(
    df: DataFrame, models: DataFrame, keys: list[str], y: str, candidates: list[list[int]] | None = None, day: str = "day", name: str = "fitted"
) -> DataFrame:
    """In-sample one-step values of one model per series (of one fold), the value itself where there is none."""
    lags = all_lags(candidates or LAG_SETS)
    rows = _lag_values(df, keys, y, lags, day).join(models.select(*keys, "d", "coefficients"), keys, "left")
    known = F.forall(F.when(F.col("d") == 1, F.col("_changes")).otherwise(F.col("_levels")), lambda v: v.isNotNull())
    fitted = F.when(known & F.col("coefficients").isNotNull(), one_step(rows, lags))
    return rows.withColumn(name, F.coalesce(fitted, F.col(y).cast("double"))).select(*df.columns, name)

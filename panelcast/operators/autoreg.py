"""Autoregressive forecasters for many series at once.

A model is fitted from sums of products, which Spark adds up per series with
map-side combining; what is left for Python is one small linear solve per
series row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.operators.frames import by_day, carry_gaps, last_rows

# Season length, 5 % bound of the Dickey-Fuller t with a constant,
# and the largest direct and seasonal orders of the order search.
SEASON = 7
UNIT_ROOT_BOUND = -2.86
DIRECT_ORDER, SEASONAL_ORDER = 5, 2


def order_grid(direct: int = DIRECT_ORDER, seasonal: int = SEASONAL_ORDER, season: int = SEASON) -> list[list[int]]:
    """The lag sets of all orders up to the given ones: the last p days, and the same day of the last P seasons."""
    return [sorted({*range(1, p + 1), *(season * q for q in range(1, w + 1))}) for w in range(seasonal + 1) for p in range(direct + 1)]


LAG_SETS = order_grid()


def with_lags(df: DataFrame, y: str, lags: list[int], keys: list[str], day: str = "day") -> DataFrame:
    spec = by_day(keys, day)
    return df.withColumns({f"_lag_{k}": F.lag(y, k).over(spec) for k in lags})


def products(y: str, terms: list[str]) -> dict[str, Column]:
    """What a regression adds up for each row: y'y, the upper triangle of X'X and X'y, where X has a leading 1."""
    columns = [F.lit(1.0), *[F.col(t).cast("double") for t in terms]]
    target = F.col(y).cast("double")
    upper = [a * b for i, a in enumerate(columns) for b in columns[i:]]
    named = {f"u{i}": e for i, e in enumerate(upper)} | {f"c{i}": a * target for i, a in enumerate(columns)}
    return {"yy": target * target} | named


def packed_sums(sums: DataFrame, keys: list[str], terms: list[str]) -> DataFrame:
    """keys, n, yy, xx and xy from summed `products`."""
    width = 1 + len(terms)
    upper, cross = (F.array(*[f"{c}{i}" for i in range(size)]) for c, size in (("u", width * (width + 1) // 2), ("c", width)))
    return sums.select(*keys, "n", "yy", upper.alias("xx"), cross.alias("xy"))


def product_sums(df: DataFrame, keys: list[str], y: str, terms: list[str]) -> DataFrame:
    """Per series: n, upper triangle of X'X, X'y and y'y, where X has a leading 1."""
    known = df.dropna(subset=[y, *terms])
    sums = known.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(e).alias(c) for c, e in products(y, terms).items()])
    return packed_sums(sums, keys, terms)


def solve_row(xx: np.ndarray, xy: np.ndarray, yy: float, n: int, used: list[int], width: int, ridge: float):
    """Coefficients and residual sum of squares for the used columns, or None when too short or singular."""
    if n < len(used) + 2:
        return None
    full = np.zeros((width, width))
    full[np.triu_indices(width)] = xx
    full = full + np.triu(full, 1).T
    a, b = full[np.ix_(used, used)], np.asarray(xy)[used]
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    scaled = a / np.outer(scale, scale) + ridge * np.eye(len(used))
    try:
        beta = np.linalg.solve(scaled, b / scale) / scale
    except np.linalg.LinAlgError:
        return None
    return beta, max(float(yy - 2 * beta @ b + beta @ a @ beta), 0.0)


def fit(
    df: DataFrame,
    keys: list[str],
    y: str,
    lags: list[int],
    exog: list[str] | None = None,
    day: str = "day",
    ridge: float = 1e-12,
) -> DataFrame:
    """Least squares of y on its lags and exogenous columns: keys, n, coefficients, rss.

    `coefficients` is intercept, lags, exogenous columns in the order given, and
    NULL for a series too short to fit.
    """
    terms = [f"_lag_{k}" for k in lags] + list(exog or [])
    sums = product_sums(with_lags(df, y, lags, keys, day), keys, y, terms)
    return solved_sums(sums, keys, 1 + len(terms), ridge)


def solved_sums(sums: DataFrame, keys: list[str], width: int, ridge: float = 1e-12) -> DataFrame:
    """The least-squares fit of each row of `product_sums`: keys, n, coefficients, rss."""
    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n long, coefficients array<double>, rss double"

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            found = [
                solve_row(r.xx, r.xy, r.yy, r.n, list(range(width)), width, ridge) for r in rows.itertuples(index=False)
            ]
            out = rows[[*keys, "n"]].copy()
            out["coefficients"] = [None if f is None else f[0].tolist() for f in found]
            out["rss"] = [None if f is None else f[1] for f in found]
            yield out

    return sums.select(*keys, "n", "yy", "xx", "xy").mapInPandas(solve, schema)


def saved_sums(df: DataFrame, keys: list[str], y: str, lags: list[int], day: str = "day") -> DataFrame:
    """What a refit needs of all days so far: `product_sums` and `recent`, the last values, as many as the longest lag.

    Saved beside a model, they let `extended_sums` take new days in without reading the old ones again.
    """
    terms = [f"_lag_{k}" for k in lags]
    sums = product_sums(with_lags(df, y, lags, keys, day), keys, y, terms)
    recent = last_rows(df.select(*keys, F.col(day).alias("d"), F.col(y).cast("double").alias("v")), max(lags), keys, "d")
    state = recent.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("recent"))
    return state.join(sums, keys, "left").fillna(0, ["n"])


def extended_sums(saved: DataFrame, fresh: DataFrame, keys: list[str], y: str, lags: list[int], day: str = "day") -> DataFrame:
    """The saved sums with those of the fresh days added; days up to a series' last saved one are left out.

    The same as `saved_sums` of all days together. The lags of the first fresh days come from `recent`. A series that was not
    saved starts here.
    """
    old = saved.select(*keys, F.inline("recent")).select(*keys, F.col("d").alias(day), F.col("v").alias("_v"), F.lit(0).alias("_fresh"))
    last = saved.select(*keys, F.element_at("recent", -1)["d"].alias("_last"))
    new = fresh.select(*keys, day, F.col(y).cast("double").alias("_v"), F.lit(1).alias("_fresh")).join(last, keys, "left")
    new = new.where(F.col("_last").isNull() | (F.col(day) > F.col("_last"))).drop("_last")
    rows = old.unionByName(new)
    terms = [f"_lag_{k}" for k in lags]
    added = product_sums(with_lags(rows, "_v", lags, keys, day).where("_fresh = 1"), keys, "_v", terms)
    recent = last_rows(rows.select(*keys, F.col(day).alias("d"), F.col("_v").alias("v")), max(lags), keys, "d")
    state = recent.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("d", "v"))).alias("recent"))
    names = ["n", "yy", "xx", "xy"]
    joined = state.join(saved.select(*keys, *[F.col(c).alias(f"_{c}") for c in names]), keys, "left").join(added, keys, "left")

    def both(name: str) -> Column:
        a, b = F.col(f"_{name}"), F.col(name)
        total = F.zip_with(a, b, lambda u, v: u + v) if name in ("xx", "xy") else a + b
        return F.coalesce(total, a, b).alias(name)

    return joined.select(*keys, "recent", *[both(c) for c in names]).fillna(0, ["n"])


def with_errors(df: DataFrame, model: DataFrame, keys: list[str], y: str, lags: list[int], day: str = "day", name: str = "error") -> DataFrame:
    """Adds what an autoregression leaves of each value; NULL where a lag is missing."""
    rows = with_lags(df, y, lags, keys, day).join(model.select(*keys, "coefficients"), keys, "left")
    value = F.element_at("coefficients", 1)
    for i, k in enumerate(lags):
        value = value + F.element_at("coefficients", 2 + i) * F.col(f"_lag_{k}")
    return rows.select(*df.columns, (F.col(y) - value).alias(name))


def fit_moving(
    df: DataFrame, keys: list[str], y: str, lags: list[int], errors: list[int], long: list[int] | None = None, day: str = "day"
) -> tuple[DataFrame, DataFrame]:
    """Autoregression with moving-average terms by regression in two stages: the model, and the rows with their `error`.

    A long autoregression (the last 14 days by default) estimates each day's error; then y is regressed on its own lags and on the lags
    of the errors. Both stages are sums of products. `coefficients` is intercept, lags, error lags. Hannan and Rissanen's method.
    """
    long = long or list(range(1, 15))
    rows = with_errors(df, fit(df, keys, y, long, day=day), keys, y, long, day)
    spec = by_day(keys, day)
    lagged = rows.withColumns({f"_error_{k}": F.lag("error", k).over(spec) for k in errors})
    return fit(lagged, keys, y, lags, [f"_error_{k}" for k in errors], day), rows


def forecast_moving(
    rows: DataFrame, model: DataFrame, keys: list[str], y: str, lags: list[int], errors: list[int], horizon: int, day: str = "day"
) -> DataFrame:
    """Steps of a model of `fit_moving` after its rows: errors still to come are 0, the past ones fade out with their lags."""
    state = lag_state(rows, keys, y, max([1, *lags]), day).join(model.select(*keys, "coefficients"), keys, "left")
    past = lag_state(rows.withColumn("error", F.coalesce("error", F.lit(0.0))), keys, "error", max(errors), day)
    state = state.join(past.select(*keys, F.col("state").alias("_errors")), keys)

    def driver(i: Column) -> Column:
        known = [F.when(F.lit(k) >= i, F.coalesce(F.try_element_at("_errors", -(F.lit(k) - i + 1)), F.lit(0.0))).otherwise(0.0) for k in errors]
        return F.struct(F.array(*known).alias("x"))

    state = state.withColumn("_drivers", F.transform(F.sequence(F.lit(1), F.lit(horizon)), driver))
    path = forecast_path(F.col("coefficients"), lags, F.col("state"), F.lit(horizon), True, len(errors))
    steps = state.select(*keys, "last_day", F.posexplode(path).alias("_i", "forecast"))
    return steps.select(*keys, (F.col("_i") + 1).alias("step"), F.date_add("last_day", F.col("_i") + 1).alias(day), "forecast")


def swept(systems: np.ndarray, place: int, alive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Jordan step on one column of many systems at once: that column enters each regression.

    The last row and column belong to the target. Afterwards the last column holds the coefficients of all columns that
    entered, its last entry what is left of the sum of squares. A column that the others already span is refused.
    """
    pivot = systems[:, place, place]
    alive = alive & (pivot > 1e-9)
    row = systems[:, place, :] / np.where(alive, pivot, 1.0)[:, None]
    out = systems - systems[:, :, place, None] * row[:, None, :]
    out[:, place, :] = row
    return out, alive


def best_lag_sets(
    n: np.ndarray, xx: np.ndarray, xy: np.ndarray, yy: np.ndarray, sets: list[list[int]], widest: list[int]
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The set of the best AIC, its coefficients by column, residual sum and AIC, for many series; set -1 where none can be fitted.

    All sets come out of one elimination: sets that share their first columns (seasonal lags first, then the nearest) share
    those steps, so a grid of orders costs one step a set.
    """
    width, many = 1 + len(widest), len(n)
    upper = np.triu_indices(width)
    systems = np.zeros((many, width + 1, width + 1))
    systems[:, upper[0], upper[1]] = xx
    systems[:, upper[1], upper[0]] = xx
    scale = np.sqrt(np.clip(systems[:, np.arange(width), np.arange(width)], 1e-300, None))
    systems[:, :width, :width] /= scale[:, :, None] * scale[:, None, :]
    systems[:, :width, width] = systems[:, width, :width] = xy / scale
    systems[:, width, width] = yy
    best, aic = np.full(many, -1), np.full(many, np.inf)
    beta, rss = np.zeros((many, width)), np.full(many, np.nan)
    known: dict[tuple[int, ...], tuple[np.ndarray, np.ndarray]] = {}

    def entered(places: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
        if places not in known:
            before = entered(places[:-1]) if len(places) > 1 else (systems, np.ones(many, bool))
            known[places] = swept(before[0], places[-1], before[1])
        return known[places]

    for number, lags in enumerate(sets):
        path = [*sorted(k for k in lags if k >= SEASON), *sorted(k for k in lags if k < SEASON)]
        places = (0, *[1 + widest.index(k) for k in path])
        reduced, alive = entered(places)
        left = np.maximum(reduced[:, width, width], 0.0)
        alive = alive & (n >= len(places) + 2)
        score = n * np.log(np.maximum(left, 1e-300) / np.maximum(n, 1)) + 2 * len(places)
        better = alive & (score < aic)
        best[better], aic[better], rss[better] = number, score[better], left[better]
        beta[better] = 0.0
        for k in places:
            beta[better, k] = reduced[better, k, width] / scale[better, k]
    return best, beta, rss, aic


def chosen_sets(sums: DataFrame, keys: list[str], sets: list[list[int]]) -> DataFrame:
    """The best lag set of each row of `product_sums` over `all_lags(sets)`: keys, n, lags, coefficients, rss, aic."""
    widest = all_lags(sets)
    types = {f.name: f.dataType.simpleString() for f in sums.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", n long, lags array<int>, coefficients array<double>, rss double, aic double"

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = rows[[*keys, "n"]].copy()
            if len(rows):
                n, yy = rows["n"].to_numpy(), np.nan_to_num(rows["yy"].to_numpy(float))
                xx, xy = (np.nan_to_num(np.array([np.asarray(v, float) for v in rows[c]])) for c in ("xx", "xy"))
                best, beta, rss, aic = best_lag_sets(n, xx, xy, yy, sets, widest)
                found = best >= 0
                out["lags"] = [sets[b] if ok else None for b, ok in zip(best, found, strict=True)]
                out["coefficients"] = [b.tolist() if ok else None for b, ok in zip(beta, found, strict=True)]
                out["rss"] = [float(v) if ok else None for v, ok in zip(rss, found, strict=True)]
                out["aic"] = [float(v) if ok else None for v, ok in zip(aic, found, strict=True)]
            else:
                out = out.assign(lags=None, coefficients=None, rss=None, aic=None)
            yield out

    return sums.mapInPandas(search, schema)


def select_lags(
    df: DataFrame, keys: list[str], y: str, candidates: list[list[int]] | None = None, day: str = "day"
) -> DataFrame:
    """Best lag set per series by AIC, on the rows all candidates can use.

    The sums of the widest design hold those of every candidate, so the search
    costs one pass over the data and one elimination per series. `coefficients` covers `all_lags(candidates)`
    with 0 for the lags not chosen, as `forecast` expects. By default all orders of the grid are tried.
    """
    sets = candidates or LAG_SETS
    widest = all_lags(sets)
    sums = product_sums(with_lags(df, y, widest, keys, day), keys, y, [f"_lag_{k}" for k in widest])
    return chosen_sets(sums, keys, sets)


def all_lags(candidates: list[list[int]] = LAG_SETS) -> list[int]:
    return sorted({k for s in candidates for k in s})


def lag_state(df: DataFrame, keys: list[str], y: str, depth: int, day: str = "day") -> DataFrame:
    """The last `depth` values of each series in time order, gaps carried forward, and its last day."""
    recent = last_rows(carry_gaps(df, [y], keys, day), depth, keys, day)
    packed = recent.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(day).alias("d"), F.col(y).cast("double").alias("v")))).alias("_s"),
        F.max(day).alias("last_day"),
    )
    return packed.select(*keys, "last_day", F.transform("_s", lambda e: e["v"]).alias("state"))


def step_value(coefficients: Column, lags: list[int], path: Column, drivers: Column | None, width: int) -> Column:
    """Next value of a path from its lags and this step's drivers; the last value if there is no model."""
    last = F.try_element_at(path, F.lit(-1))
    value = F.element_at(coefficients, 1)
    for i, k in enumerate(lags):
        value = value + F.element_at(coefficients, 2 + i) * F.coalesce(F.try_element_at(path, F.lit(-k)), last)
    if drivers is not None:
        for j in range(width):
            value = value + F.element_at(coefficients, 2 + len(lags) + j) * F.get(drivers, F.lit(j))
    return F.coalesce(value, last)


def forecast(
    history: DataFrame,
    model: DataFrame,
    keys: list[str],
    y: str,
    lags: list[int],
    horizon: int,
    drivers: DataFrame | None = None,
    exog: list[str] | None = None,
    day: str = "day",
    name: str = "forecast",
) -> DataFrame:
    """`horizon` recursive steps per series, all series in one job.

    The recursion runs over the steps inside an array expression, so it stays
    in the JVM. `drivers` holds the exogenous columns of the future days.
    """
    exog = list(exog or [])
    state = lag_state(history, keys, y, max([1, *lags]), day).join(model.select(*keys, "coefficients"), keys, "left")
    if drivers is not None:
        packed = drivers.groupBy(*keys).agg(
            F.array_sort(
                F.collect_list(F.struct(F.col(day).alias("d"), F.array(*[F.col(c).cast("double") for c in exog]).alias("x")))
            ).alias("_drivers")
        )
        state = state.join(packed, keys, "left")
    steps = state.withColumn("_path", forecast_path(F.col("coefficients"), lags, F.col("state"), F.lit(horizon), drivers is not None, len(exog)))
    rows = steps.select(*keys, "last_day", F.posexplode("_path").alias("_i", name))
    return rows.select(
        *keys, (F.col("_i") + 1).alias("step"), F.date_add("last_day", F.col("_i") + 1).alias(day), F.col(name)
    )


def forecast_path(coefficients: Column, lags: list[int], state: Column, horizon: Column, driven: bool = False, width: int = 0) -> Column:
    """The next `horizon` values after the state (the last values in time order), each step from the ones before it.

    With `driven`, the column `_drivers` holds the exogenous values of the steps.
    """

    def step(path: Column, i: Column) -> Column:
        now = F.get(F.col("_drivers"), i - 1)["x"] if driven else None
        return F.array_append(path, step_value(coefficients, lags, path, now, width))

    path = F.aggregate(F.sequence(F.lit(1), horizon), state, step)
    return F.slice(path, F.size(state) + 1, horizon)


def forecast_drivers(
    df: DataFrame, keys: list[str], columns: list[str], horizon: int, day: str = "day", least: int = 14
) -> DataFrame:
    """Future values of each exogenous column: a small AR, or the last value below `least` known days.

    The columns become rows of a longer panel, so one fit serves all of them. A
    column without any value gives 0.
    """
    lags = [1, 2]
    long = df.unpivot([*keys, day], columns, "variable", "value").withColumn("value", F.col("value").cast("double"))
    wide_keys = [*keys, "variable"]
    counts = long.groupBy(*wide_keys).agg(F.count("value").alias("_known"))
    model = fit(long, wide_keys, "value", lags, day=day).join(counts, wide_keys)
    model = model.withColumn("coefficients", F.when(F.col("_known") >= least, F.col("coefficients")))
    ahead = forecast(long, model, wide_keys, "value", lags, horizon, day=day, name="value")
    ahead = ahead.withColumn("value", F.coalesce("value", F.lit(0.0)))
    return ahead.groupBy(*keys, "step", day).pivot("variable", columns).agg(F.first("value"))


def fit_first_order(df: DataFrame, keys: list[str], y: str, day: str = "day") -> DataFrame:
    """AR(1) by simple regression of y on its previous row."""
    pairs = with_lags(df, y, [1], keys, day)
    return pairs.groupBy(*keys).agg(
        F.regr_count(y, "_lag_1").alias("n"),
        F.regr_slope(y, "_lag_1").alias("phi"),
        F.regr_intercept(y, "_lag_1").alias("intercept"),
    )


def first_order_path(intercept: Column, phi: Column, last: Column, step: Column) -> Column:
    """Value `step` ahead: the mean plus the decayed distance from it; a straight line when phi is 1."""
    mean = intercept / (F.lit(1.0) - phi)
    curve = mean + F.pow(phi, step) * (last - mean)
    return F.coalesce(F.when(phi == 1.0, last + intercept * step).otherwise(curve), last)


def forecast_first_order(
    history: DataFrame, model: DataFrame, keys: list[str], y: str, horizon: int, day: str = "day"
) -> DataFrame:
    """AR(1) path from the last known value; other history than the fit used is an update without refit."""
    known = history.where(F.col(y).isNotNull())
    last = known.groupBy(*keys).agg(F.max(day).alias("_last"), F.max_by(y, day).alias("_value"))
    steps = last.join(model, keys, "left").select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    value = first_order_path(F.col("intercept"), F.col("phi"), F.col("_value"), F.col("step"))
    return steps.select(*keys, "step", F.date_add("_last", F.col("step")).alias(day), value.alias("forecast"))


def fitted_first_order(df: DataFrame, model: DataFrame, keys: list[str], y: str, day: str = "day") -> DataFrame:
    """In-sample one-step values; the first row of a series has none."""
    pairs = with_lags(df, y, [1], keys, day).join(model.select(*keys, "phi", "intercept"), keys)
    return pairs.withColumn("fitted", F.col("intercept") + F.col("phi") * F.col("_lag_1")).drop(
        "_lag_1", "phi", "intercept"
    )


def refit_each_day(
    df: DataFrame, keys: list[str], y: str, day: str = "day", least: int = 30, name: str = "forecast"
) -> DataFrame:
    """One-step AR(1) forecast of every day from a fit on all days before it.

    The expanding frame adds each row once, so refitting daily costs one pass.
    Days with fewer than `least` earlier pairs have no forecast.
    """
    spec = by_day(keys, day)
    earlier = spec.rowsBetween(W.unboundedPreceding, -1)
    pairs = with_lags(df, y, [1], keys, day)
    fits = pairs.withColumns(
        {
            "_n": F.regr_count(y, "_lag_1").over(earlier),
            "_phi": F.regr_slope(y, "_lag_1").over(earlier),
            "_intercept": F.regr_intercept(y, "_lag_1").over(earlier),
        }
    )
    value = F.when(F.col("_n") >= least, F.col("_intercept") + F.col("_phi") * F.col("_lag_1"))
    return fits.withColumn(name, value).drop("_lag_1", "_n", "_phi", "_intercept")


def solved_rows(rows: DataFrame, keep: list[str], widest: list[int], name: str) -> DataFrame:
    """One least-squares fit per row from its own sums, and the value it gives: `keep` columns and `name`.

    rows: keep, _n, _xx, _xy (sums of products of the widest design), _lags (the columns that this row's fit uses) and _now (their values
    today). Rows of a batch that use the same lags are solved together. NULL where the sums are too few for the lags.
    """
    width = 1 + len(widest)
    upper = np.triu_indices(width)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            many = batch.num_rows
            out = np.full(many, np.nan)
            lags = column["_lags"].to_pylist()
            n = column["_n"].to_numpy(zero_copy_only=False)

            def matrix(name: str, size: int, column=column, many=many) -> np.ndarray:
                return column[name].flatten().to_numpy(zero_copy_only=False).reshape(many, size)

            if many:
                xx, xy, now = matrix("_xx", len(upper[0])), matrix("_xy", width), matrix("_now", width)
            groups: dict[tuple[int, ...], list[int]] = {}
            for i, own in enumerate(lags):
                if own is not None and n[i] >= len(own) + 3:
                    groups.setdefault(tuple(own), []).append(i)
            for own, members in groups.items():
                used = [0, *[1 + widest.index(k) for k in own]]
                full = np.zeros((len(members), width, width))
                full[:, upper[0], upper[1]] = xx[members]
                full[:, upper[1], upper[0]] = xx[members]
                a, b = full[:, used][:, :, used], xy[members][:, used]
                scale = np.sqrt(np.clip(np.einsum("ijj->ij", a), 1e-300, None))
                a = a / (scale[:, :, None] * scale[:, None, :]) + 1e-12 * np.eye(len(used))
                beta = np.linalg.pinv(a, hermitian=True) @ (b / scale)[:, :, None]
                out[members] = (beta[:, :, 0] / scale * now[members][:, used]).sum(1)
            columns = [column[k] for k in keep]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, mask=~np.isfinite(out))], names=[*keep, name])

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"`{k}` {types[k]}" for k in keep) + f", `{name}` double"
    return rows.select(*keep, "_n", "_xx", "_xy", "_lags", "_now").mapInArrow(solve, schema)


def refit_selected(
    df: DataFrame,
    model: DataFrame,
    keys: list[str],
    y: str,
    candidates: list[list[int]] | None = None,
    day: str = "day",
    name: str = "forecast",
    days: Column | None = None,
) -> DataFrame:
    """One-step forecast of every day by the selected order of its series, refitted on all days before it.

    `model` says which lags a series uses and whether its changes are modelled (`select_model`, or any table of
    keys, lags and d); its coefficients are not used. The sums of products of the widest design grow by one row a day in an
    expanding frame, so refitting daily costs one pass; what is left is a small solve a day, many of them together. A lag that
    is missing takes the last known value, as in `forecast`. Days with fewer known rows than the lags need have no
    forecast. `days` limits the days that are forecast; all days before them are fitted on.
    """
    widest = all_lags(candidates or LAG_SETS)
    spec = by_day(keys, day)
    earlier = spec.rowsBetween(W.unboundedPreceding, -1)
    rows = differenced(df.withColumn("_value", F.col(y).cast("double")), model, keys, "_value", day)
    rows = rows.withColumn("_level", F.col(y).cast("double"))
    rows = with_lags(rows, "_value", widest, keys, day).join(model.select(*keys, F.col("lags").alias("_lags")), keys, "left")
    terms = [F.lit(1.0), *[F.col(f"_lag_{k}") for k in widest]]
    known = F.col("_value").isNotNull()
    for k in widest:
        known = known & F.col(f"_lag_{k}").isNotNull()

    def total(value: Column) -> Column:
        return F.coalesce(F.sum(F.when(known, value)).over(earlier), F.lit(0.0))

    last, level = (F.last(c, ignorenulls=True).over(earlier) for c in ("_value", "_level"))
    summed = rows.select(
        *df.columns,
        "_lags",
        F.coalesce(F.sum(F.when(known, 1)).over(earlier), F.lit(0)).cast("long").alias("_n"),
        F.array(*[total(a * b) for i, a in enumerate(terms) for b in terms[i:]]).alias("_xx"),
        F.array(*[total(a * F.col("_value")) for a in terms]).alias("_xy"),
        F.array(F.lit(1.0), *[F.coalesce(f"_lag_{k}", last) for k in widest]).alias("_now"),
        F.when(F.col("d") == 1, level).otherwise(0.0).alias("_base"),
    )
    summed = summed if days is None else summed.where(days)
    # a day whose lags reach back before the series has no value to start from
    ready = summed.withColumn("_now", F.transform("_now", lambda v: F.coalesce(v, F.lit(float("nan")))))
    solved = solved_rows(ready, [*df.columns, "_base"], widest, "_step")
    return solved.withColumn(name, F.col("_step") + F.col("_base")).drop("_step", "_base")


def dickey_fuller(df: DataFrame, keys: list[str], y: str, day: str = "day") -> DataFrame:
    """t statistic of the Dickey-Fuller regression: the daily change on the previous value.

    NULL where the regression leaves no error or has no spread (a straight, constant or strictly
    alternating series, or one of too few days): nothing is tested there.
    """
    pairs = with_lags(df, y, [1], keys, day).withColumn("_change", F.col(y) - F.col("_lag_1"))
    sums = pairs.groupBy(*keys).agg(
        F.regr_count("_change", "_lag_1").alias("n"),
        F.regr_slope("_change", "_lag_1").alias("slope"),
        F.regr_sxx("_change", "_lag_1").alias("_sxx"),
        F.regr_syy("_change", "_lag_1").alias("_syy"),
        F.regr_sxy("_change", "_lag_1").alias("_sxy"),
    )
    # what is left of the spread after the regression; below this share it is rounding
    residual = F.greatest(F.col("_syy") - F.col("slope") * F.col("_sxy"), F.lit(0.0))
    residual = F.when(residual > F.col("_syy") * 1e-12, residual)
    error = F.sqrt(F.try_divide(F.try_divide(residual, F.col("n") - 2), F.col("_sxx")))
    return sums.select(*keys, "n", "slope", F.when(F.col("n") > 2, F.try_divide("slope", error)).alias("t_value"))


def seasonal_naive(df: DataFrame, keys: list[str], y: str, day: str = "day", season: int = SEASON) -> DataFrame:
    """The value one season ago, else the previous value."""
    spec = by_day(keys, day)
    return df.withColumn("naive", F.coalesce(F.lag(y, season).over(spec), F.lag(y, 1).over(spec)))


def difference_order(
    df: DataFrame, keys: list[str], y: str, day: str = "day", bound: float = UNIT_ROOT_BOUND
) -> DataFrame:
    """`d` is 1 for a series whose unit root is not rejected, else 0."""
    tested = dickey_fuller(df, keys, y, day)
    return tested.select(*keys, "t_value", F.when(F.col("t_value") > bound, 1).otherwise(0).alias("d"))


def differenced(df: DataFrame, orders: DataFrame, keys: list[str], y: str, day: str = "day") -> DataFrame:
    """Daily changes in place of the values, for the series with `d` = 1; `_previous` is the value before."""
    rows = df.withColumn("_previous", F.lag(y, 1).over(by_day(keys, day)))
    rows = rows.join(orders.select(*keys, "d"), keys, "left")
    return rows.withColumn(y, F.when(F.col("d") == 1, F.col(y) - F.col("_previous")).otherwise(F.col(y)))


def select_model(
    df: DataFrame, keys: list[str], y: str, candidates: list[list[int]] | None = None, day: str = "day"
) -> DataFrame:
    """Differencing by the unit-root test, then the lag set by AIC: the model table of `forecast_selected`."""
    orders = difference_order(df, keys, y, day)
    rows = differenced(df, orders, keys, y, day).drop("_previous", "d")
    # a series too short for any lag set keeps its row, without coefficients
    return orders.select(*keys, "d").join(select_lags(rows, keys, y, candidates, day), keys, "left").fillna(0, ["n"])


def forecast_selected(
    history: DataFrame,
    model: DataFrame,
    keys: list[str],
    y: str,
    horizon: int,
    candidates: list[list[int]] | None = None,
    day: str = "day",
) -> DataFrame:
    """Steps of a selected model; forecast changes are added up from the last known value."""
    rows = differenced(history, model, keys, y, day).drop("_previous", "d")
    steps = forecast(rows, model, keys, y, all_lags(candidates or LAG_SETS), horizon, day=day)
    known = history.where(F.col(y).isNotNull())
    last = known.groupBy(*keys).agg(F.max_by(y, day).cast("double").alias("_last"))
    joined = steps.join(model.select(*keys, "d"), keys, "left").join(last, keys, "left")
    total = F.col("_last") + F.sum("forecast").over(W.partitionBy(*keys).orderBy("step"))
    value = F.when(F.col("d") == 1, total).otherwise(F.col("forecast"))
    return joined.withColumn("forecast", value).drop("d", "_last")


def fitted_selected(
    df: DataFrame,
    model: DataFrame,
    keys: list[str],
    y: str,
    candidates: list[list[int]] | None = None,
    day: str = "day",
    name: str = "fitted",
) -> DataFrame:
    """In-sample one-step values of a selected model; the value itself where it has none."""
    lags = all_lags(candidates or LAG_SETS)
    rows = differenced(df.withColumn("_value", F.col(y)), model, keys, y, day)
    rows = with_lags(rows, y, lags, keys, day).join(model.select(*keys, "coefficients"), keys, "left")
    value = F.element_at("coefficients", 1)
    for i, k in enumerate(lags):
        value = value + F.element_at("coefficients", 2 + i) * F.col(f"_lag_{k}")
    value = F.when(F.col("d") == 1, value + F.col("_previous")).otherwise(value)
    fitted = rows.withColumn(name, F.coalesce(value, F.col("_value"))).withColumn(y, F.col("_value"))
    return fitted.select(*df.columns, name)

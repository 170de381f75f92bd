"""Autoregressive forecasts, folds and back-tests on the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import (
    BAND,
    CUSTOMER_SPANS,
    FULL,
    MEASURES,
    OBS,
    PANEL,
    band,
    customer_spans,
    full_panel,
    iso,
    measures,
    obs,
    panel,
    r,
    rounded,
    stored_measures,
    stored_panel,
)
from panelcast.catalog.registry import query
from panelcast.operators.autoreg import (
    dickey_fuller,
    extended_sums,
    fit,
    fit_first_order,
    fit_moving,
    fitted_first_order,
    forecast_drivers,
    forecast_first_order,
    forecast_moving,
    refit_each_day,
    refit_selected,
    saved_sums,
    seasonal_naive,
    select_model,
    solved_sums,
)
from panelcast.operators import foldfits
from panelcast.operators.clean import before
from panelcast.operators.foldfits import backtest_frozen, fold_models
from panelcast.operators.folds import (
    backtest_first_order,
    chronological_split,
    folds_every,
    folds_last,
    folds_or_split,
)
from panelcast.operators.frames import next_day, window_features
from panelcast.operators.resample import daily, day_span
from panelcast.operators.scores import average_over
from panelcast.plans.evaluation import evaluation_scores
from panelcast.plans.features import FeatureSpec
from panelcast.plans.forecasting import future_features, future_rows
from panelcast.session import materialise

DAY = "strftime(day, '%Y-%m-%d') AS day"
KEYS = ["series_id"]
W = "WINDOW w AS (PARTITION BY series_id ORDER BY day)"
CUTOFF = date(2001, 1, 1)

PAIRS = f"""{FULL}, pairs AS (SELECT series_id, day, y, lag(y) OVER w AS x FROM full_panel {W})"""
AR1 = f"""{PAIRS}, model AS (
  SELECT series_id, CAST(regr_count(y, x) AS BIGINT) AS n, regr_slope(y, x) AS phi, regr_intercept(y, x) AS intercept
  FROM pairs GROUP BY 1)"""
AR1_TRAIN = f"""{PAIRS}, model AS (
  SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS intercept
  FROM pairs WHERE day < DATE '2001-01-01' GROUP BY 1)"""
LAST = "last AS (SELECT series_id, max(day) AS last_day, arg_max(y, day) AS y FROM {0} WHERE y IS NOT NULL GROUP BY 1)"
STEPS = "steps AS (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS step)"
PATH = """SELECT series_id, step, strftime(last_day + step, '%Y-%m-%d') AS day,
  round(intercept / (1 - phi) + power(phi, step) * (y - intercept / (1 - phi)), 4) AS forecast
  FROM model JOIN last USING (series_id), steps"""


@query("ar1_fit", f"WITH {AR1} SELECT series_id, n, round(phi, 6) AS phi, round(intercept, 4) AS intercept FROM model")
def ar1_fit(spark: SparkSession, sf: str) -> DataFrame:
    model = fit_first_order(full_panel(spark, sf), KEYS, "y")
    return model.withColumns({"phi": r("phi", 6), "intercept": r("intercept")})


@query("ar1_forecast", f"WITH {AR1}, {LAST.format('full_panel')}, {STEPS} {PATH}")
def ar1_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_panel(spark, sf)
    path = forecast_first_order(rows, fit_first_order(rows, KEYS, "y"), KEYS, "y", 7)
    return path.withColumns({"day": iso("day"), "forecast": r("forecast")})


@query("ar1_update", f"WITH {AR1_TRAIN}, {LAST.format('full_panel')}, {STEPS} {PATH}")
def ar1_update(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_panel(spark, sf)
    model = fit_first_order(before(rows, F.lit(CUTOFF)), KEYS, "y")
    path = forecast_first_order(rows, model, KEYS, "y", 7)
    return path.withColumns({"day": iso("day"), "forecast": r("forecast")})


@query(
    "ar1_insample",
    f"""WITH {AR1} SELECT series_id, {DAY}, y, round(intercept + phi * x, 4) AS fitted
    FROM pairs JOIN model USING (series_id)""",
)
def ar1_insample(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_panel(spark, sf)
    fitted = fitted_first_order(rows, fit_first_order(rows, KEYS, "y"), KEYS, "y")
    return fitted.select("series_id", iso("day").alias("day"), "y", r("fitted").alias("fitted"))


@query(
    "dickey_fuller_t",
    f"""WITH {PAIRS}, s AS (
      SELECT series_id, CAST(regr_count(y - x, x) AS BIGINT) AS n, regr_slope(y - x, x) AS slope, regr_sxx(y - x, x) AS sxx,
        regr_syy(y - x, x) AS syy, regr_sxy(y - x, x) AS sxy FROM pairs GROUP BY 1)
    SELECT series_id, n, round(slope, 6) AS slope, round(slope / sqrt((syy - slope * sxy) / (n - 2) / sxx), 6) AS t_value
    FROM s""",
)
def dickey_fuller_t(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(dickey_fuller(full_panel(spark, sf), KEYS, "y"), ["slope", "t_value"], 6)


TWO = """sums AS (
  SELECT series_id, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb,
    covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby, covar_pop(y, y) AS syy
  FROM design WHERE y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL GROUP BY 1),
betas AS (
  SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb
  FROM sums)
SELECT series_id, n, CASE WHEN n >= 5 THEN round(my - ba * ma - bb * mb, 4) END AS intercept,
  CASE WHEN n >= 5 THEN round(ba, 6) END AS first, CASE WHEN n >= 5 THEN round(bb, 6) END AS second,
  CASE WHEN n >= 5 THEN round(n * (syy - ba * say - bb * sby), 2) END AS rss FROM betas"""


def two_terms(model: DataFrame) -> DataFrame:
    c = F.col("coefficients")
    return model.select(
        "series_id",
        "n",
        r(c[0], 4).alias("intercept"),
        r(c[1], 6).alias("first"),
        r(c[2], 6).alias("second"),
        r("rss", 2).alias("rss"),
    )


@query(
    "ar_seasonal_fit",
    f"WITH {FULL}, design AS (SELECT series_id, y, lag(y, 1) OVER w AS a, lag(y, 7) OVER w AS b FROM full_panel {W}), {TWO}",
)
def ar_seasonal_fit(spark: SparkSession, sf: str) -> DataFrame:
    return two_terms(fit(full_panel(spark, sf), KEYS, "y", [1, 7]))


@query(
    "ar_extend",
    f"WITH {FULL}, design AS (SELECT series_id, y, lag(y, 1) OVER w AS a, lag(y, 7) OVER w AS b FROM full_panel {W}), {TWO}",
)
def ar_extend(spark: SparkSession, sf: str) -> DataFrame:
    """A fit from saved sums of the days up to a date and the days after it, as if all had been read."""
    rows, lags = stored_panel(spark, sf), [1, 7]
    saved = materialise(spark, saved_sums(before(rows, F.lit(CUTOFF)), KEYS, "y", lags), "sums")
    extended = extended_sums(saved, rows.where(F.col("day") >= F.lit(CUTOFF)), KEYS, "y", lags)
    return two_terms(solved_sums(extended, KEYS, 3))


@query(
    "arma_fit",
    f"""SELECT series_id, n, round(rss, 1) AS rss FROM (
    WITH {PAIRS}, long AS (SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS c FROM pairs GROUP BY 1),
    left_over AS (SELECT series_id, day, y, x, y - c - phi * x AS e FROM pairs JOIN long USING (series_id)),
    design AS (SELECT series_id, y, x AS a, lag(e) OVER w AS b FROM left_over {W}), {TWO})""",
)
def arma_fit(spark: SparkSession, sf: str) -> DataFrame:
    """One lag and one moving-average term; the errors of the first stage come from one lag, as SQL can say that.

    On these values both terms nearly cancel, so the errors are compared and not the terms.
    """
    return two_terms(fit_moving(stored_panel(spark, sf), KEYS, "y", [1], [1], [1])[0]).select("series_id", "n", r("rss", 1).alias("rss"))


@query("arma_forecast")
def arma_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """A week ahead by lags of a day and a week and two moving-average terms, errors from the last 14 days."""
    model, rows = fit_moving(stored_panel(spark, sf), KEYS, "y", [1, 7], [1, 7])
    ahead = forecast_moving(materialise(spark, rows, "errors"), model, KEYS, "y", [1, 7], [1, 7], 7)
    return ahead.withColumns({"day": iso("day"), "forecast": r("forecast")})


@query(
    "arx_fit",
    f"""WITH {MEASURES}, design AS (
      SELECT series_id, temperature AS y, lag(temperature) OVER w AS a, humidity AS b FROM measures {W}), {TWO}""",
)
def arx_fit(spark: SparkSession, sf: str) -> DataFrame:
    return two_terms(fit(measures(spark, sf), KEYS, "temperature", [1], ["humidity"]))


@query("ar_select")
def ar_select(spark: SparkSession, sf: str) -> DataFrame:
    best = select_model(stored_panel(spark, sf), KEYS, "y")
    return best.select("series_id", "n", "d", F.concat_ws(",", "lags").alias("lags"), r("rss", 2).alias("rss"), r("aic").alias("aic"))


DRIVERS = """long_rows AS (
  SELECT series_id, 'humidity' AS variable, day, humidity AS y FROM measures
  UNION ALL SELECT series_id, 'wind', day, wind FROM measures
  UNION ALL SELECT series_id, 'cloud', day, cloud FROM measures),
design AS (
  SELECT series_id, variable, day, y, lag(y, 1) OVER v AS a, lag(y, 2) OVER v AS b FROM long_rows
  WINDOW v AS (PARTITION BY series_id, variable ORDER BY day)),
sums AS (
  SELECT series_id, variable, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, covar_pop(a, a) AS saa, covar_pop(b, b) AS sbb,
    covar_pop(a, b) AS sab, covar_pop(a, y) AS say, covar_pop(b, y) AS sby
  FROM design WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1, 2),
betas AS (
  SELECT series_id, variable, my, ma, mb, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba,
    (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM sums),
path(series_id, variable, step, day, now, before) AS (
  SELECT series_id, variable, 0, max(day), arg_max(y, day), arg_max(a, day) FROM design GROUP BY 1, 2
  UNION ALL
  SELECT p.series_id, p.variable, step + 1, p.day + 1, my - ba * ma - bb * mb + ba * now + bb * before, now
  FROM path p JOIN betas b ON b.series_id = p.series_id AND b.variable = p.variable WHERE step < 7)"""


@query(
    "exog_forecast",
    f"""WITH RECURSIVE {MEASURES}, {DRIVERS} SELECT series_id, CAST(step AS INTEGER) AS step, {DAY},
      round(max(now) FILTER (WHERE variable = 'humidity'), 4) AS humidity,
      round(max(now) FILTER (WHERE variable = 'wind'), 4) AS wind,
      round(max(now) FILTER (WHERE variable = 'cloud'), 4) AS cloud
    FROM path WHERE step > 0 GROUP BY series_id, step, path.day""",
)
def exog_forecast(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["humidity", "wind", "cloud"]
    ahead = forecast_drivers(stored_measures(spark, sf), KEYS, columns, 7)
    return rounded(ahead.withColumn("day", iso("day")), columns)


@query(
    "seasonal_naive",
    f"WITH {FULL} SELECT series_id, {DAY}, y, coalesce(lag(y, 7) OVER w, lag(y, 1) OVER w) AS naive FROM full_panel {W}",
)
def naive_by_week(spark: SparkSession, sf: str) -> DataFrame:
    rows = seasonal_naive(full_panel(spark, sf), KEYS, "y")
    return rows.select("series_id", iso("day").alias("day"), "y", "naive")


def dates(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: iso(c) for c in ("train_start", "train_end", "test_start", "test_end")})


FOLD_DATES = """SELECT series_id, fold, strftime(first_day, '%Y-%m-%d') AS train_start,
  strftime(first_day + ts - 1, '%Y-%m-%d') AS train_end, strftime(first_day + ts, '%Y-%m-%d') AS test_start,
  strftime(first_day + te - 1, '%Y-%m-%d') AS test_end FROM placed"""
TOTALS = f"{CUSTOMER_SPANS}, totals AS (SELECT *, CAST(date_diff('day', first_day, last_day) + 1 AS INTEGER) AS total FROM spans)"


@query(
    "folds_last_n",
    f"""WITH {TOTALS}, numbers AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS i),
    placed AS (
      SELECT series_id, first_day, i + 1 AS fold, greatest(365, total - 300) + i * 30 AS ts,
        least(greatest(365, total - 300) + i * 30 + 30, total) AS te FROM totals, numbers)
    {FOLD_DATES} WHERE te > ts""",
)
def folds_last_n(spark: SparkSession, sf: str) -> DataFrame:
    return dates(folds_last(customer_spans(spark, sf), KEYS))


@query(
    "folds_all",
    f"""WITH {TOTALS}, numbers AS (SELECT CAST(unnest(range(0, 200)) AS INTEGER) AS i),
    placed AS (
      SELECT series_id, first_day, i + 1 AS fold, 365 + i * 60 AS ts, 365 + i * 60 + 60 AS te, total FROM totals, numbers)
    {FOLD_DATES} WHERE te <= total""",
)
def folds_all(spark: SparkSession, sf: str) -> DataFrame:
    return dates(folds_every(customer_spans(spark, sf), KEYS))


@query(
    "folds_or_split",
    f"""WITH {TOTALS}, numbers AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS i),
    sized AS (SELECT *, least(10, (total - 730) // 30) AS many, CAST(floor(total * CAST(0.8 AS DOUBLE)) AS INTEGER) AS cut FROM totals),
    placed AS (
      SELECT series_id, first_day, i + 1 AS fold, total - (many - i) * 30 AS ts, total - (many - i) * 30 + 30 AS te
      FROM sized, numbers WHERE total >= 760 AND i < many
      UNION ALL SELECT series_id, first_day, 1, cut, total FROM sized WHERE total < 760 AND cut > 0 AND cut < total)
    {FOLD_DATES}""",
)
def folds_or_single_split(spark: SparkSession, sf: str) -> DataFrame:
    return dates(folds_or_split(customer_spans(spark, sf), KEYS))


@query(
    "split_80_20",
    f"""WITH {PANEL}, placed AS (
      SELECT series_id, day, y, row_number() OVER (PARTITION BY series_id ORDER BY day) AS rn,
        count(*) OVER (PARTITION BY series_id) AS n FROM panel)
    SELECT series_id, {DAY}, y, CASE WHEN rn <= floor(n * CAST(0.8 AS DOUBLE)) THEN 'train' ELSE 'test' END AS part FROM placed""",
)
def split_80_20(spark: SparkSession, sf: str) -> DataFrame:
    return chronological_split(panel(spark, sf).select("series_id", "day", "y"), KEYS).withColumn("day", iso("day"))


REFIT = """fits AS (
  SELECT series_id, day, y, x, regr_count(y, x) OVER e AS n, regr_slope(y, x) OVER e AS phi, regr_intercept(y, x) OVER e AS c
  FROM pairs WINDOW e AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query(
    "backtest_refit",
    f"""WITH {PAIRS}, {REFIT} SELECT series_id, {DAY}, y,
    CASE WHEN n >= 30 THEN round(c + phi * x, 4) END AS forecast FROM fits""",
)
def backtest_refit(spark: SparkSession, sf: str) -> DataFrame:
    rows = refit_each_day(full_panel(spark, sf), KEYS, "y")
    return rows.select("series_id", iso("day").alias("day"), "y", r("forecast").alias("forecast"))


TWO_LAGS = f"""{FULL}, design AS (
  SELECT series_id, day, y, lag(y, 1) OVER w AS a, lag(y, 7) OVER w AS b,
    last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM full_panel {W}),
known AS (
  SELECT series_id, day, y, coalesce(a, before) AS x1, coalesce(b, before) AS x2, y IS NOT NULL AND a IS NOT NULL AND b IS NOT NULL AS k,
    CASE WHEN k THEN y END AS ky, CASE WHEN k THEN a END AS ka, CASE WHEN k THEN b END AS kb FROM design),
grown AS (
  SELECT series_id, day, y, x1, x2, count(ky) OVER e AS n, avg(ky) OVER e AS my, avg(ka) OVER e AS ma, avg(kb) OVER e AS mb,
    covar_pop(ka, ka) OVER e AS saa, covar_pop(kb, kb) OVER e AS sbb, covar_pop(ka, kb) OVER e AS sab,
    covar_pop(ka, ky) OVER e AS say, covar_pop(kb, ky) OVER e AS sby
  FROM known WINDOW e AS (PARTITION BY series_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fits AS (
  SELECT *, (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS ba, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS bb FROM grown),
refitted AS (
  SELECT series_id, day, y, CASE WHEN n >= 5 THEN my - ba * ma - bb * mb + ba * x1 + bb * x2 END AS forecast FROM fits)"""


def refitted(spark: SparkSession, sf: str) -> DataFrame:
    """Every day forecast by yesterday and the same day of last week, refitted on all days before it."""
    rows = stored_panel(spark, sf).select("series_id", "day", "y")
    orders = rows.select("series_id").distinct().withColumns({"lags": F.array(F.lit(1), F.lit(7)), "d": F.lit(0)})
    return refit_selected(rows, orders, KEYS, "y", [[1, 7]])


@query("backtest_refit_lags", f"WITH {TWO_LAGS} SELECT series_id, {DAY}, y, round(forecast, 4) AS forecast FROM refitted")
def backtest_refit_lags(spark: SparkSession, sf: str) -> DataFrame:
    return refitted(spark, sf).withColumns({"day": iso("day"), "forecast": r("forecast")})


# the evaluated range: classes are value bands, of the actual and of the forecast mean
RESULTS = f"""{TWO_LAGS}, results AS (
  SELECT series_id, day, y AS actual, forecast AS predicted, {BAND.format('y')} AS a, {BAND.format('forecast')} AS p
  FROM refitted WHERE day BETWEEN DATE '2000-01-01' AND DATE '2001-06-02' AND y IS NOT NULL AND forecast IS NOT NULL)"""


def results(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    inside = F.col("day").between(F.lit(date(2000, 1, 1)), F.lit(date(2001, 6, 2)))
    rows = refitted(spark, sf).where(inside).withColumnsRenamed({"y": "actual_mean", "forecast": "predicted_mean"})
    rows = rows.withColumns({"actual_label": band(F.col("actual_mean")), "predicted_label": band(F.col("predicted_mean"))})
    return evaluation_scores(rows, [0, 1, 2, 3])


@query(
    "historical_metrics",
    f"""WITH {RESULTS} SELECT count(*) AS n, round(avg(abs(predicted - actual)), 6) AS mae,
      round(sqrt(avg((predicted - actual) * (predicted - actual))), 6) AS rmse, round(avg(predicted - actual), 6) + 0.0 AS bias,
      round(avg(CASE WHEN a = p THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM results""",
)
def historical_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Errors and accuracy of a past range, over its complete days."""
    scores = results(spark, sf)
    return rounded(scores["mean"].join(scores["accuracy"], "n"), ["mae", "rmse", "bias", "accuracy"], 6)


@query(
    "historical_report",
    f"""WITH {RESULTS}, labels AS (SELECT a AS label FROM results UNION SELECT p FROM results),
    counts AS (
      SELECT label, (SELECT count(*) FROM results WHERE a = label) AS support, (SELECT count(*) FROM results WHERE p = label) AS named,
        (SELECT count(*) FROM results WHERE a = label AND p = label) AS hits FROM labels),
    rated AS (
      SELECT CAST(label AS VARCHAR) AS label, coalesce(hits / nullif(named, 0), 0) AS precision,
        coalesce(hits / nullif(support, 0), 0) AS recall, coalesce(2 * hits / nullif(named + support, 0), 0) AS f1, support FROM counts),
    report AS (
      SELECT * FROM rated
      UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM rated
      UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
        sum(f1 * support) / sum(support), sum(support) FROM rated)
    SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support
    FROM report""",
)
def historical_report(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(results(spark, sf)["report"], ["precision", "recall", "f1"], 6)


DIRECT = f"""{PAIRS}, totals AS (
  SELECT series_id, first_day, CAST(date_diff('day', first_day, last_day) + 1 AS INTEGER) AS total FROM spans),
numbers AS (SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS i),
folds AS (
  SELECT series_id, i + 1 AS fold, first_day + greatest(365, total - 300) + i * 30 AS test_start,
    first_day + least(greatest(365, total - 300) + i * 30 + 30, total) - 1 AS test_end
  FROM totals, numbers WHERE greatest(365, total - 300) + i * 30 < total),
model AS (
  SELECT f.series_id, f.fold, regr_slope(p.y, p.x) AS phi, regr_intercept(p.y, p.x) AS c,
    arg_max(p.y, p.day) FILTER (WHERE p.y IS NOT NULL) AS last_y, max(p.day) FILTER (WHERE p.y IS NOT NULL) AS last_day
  FROM folds f JOIN pairs p ON p.series_id = f.series_id AND p.day < f.test_start GROUP BY 1, 2),
direct AS (
  SELECT p.series_id, f.fold, p.day, p.y,
    c / (1 - phi) + power(phi, date_diff('day', last_day, p.day)) * (last_y - c / (1 - phi)) AS forecast
  FROM folds f JOIN model m ON m.series_id = f.series_id AND m.fold = f.fold
  JOIN pairs p ON p.series_id = f.series_id AND p.day BETWEEN f.test_start AND f.test_end)"""


def direct(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_panel(spark, sf).select("series_id", "day", "y")
    folds = folds_last(day_span(rows, KEYS), KEYS)
    return backtest_first_order(rows, folds, KEYS, "y").drop("_lag_1")


@query("backtest_direct", f"WITH {DIRECT} SELECT series_id, fold, {DAY}, y, round(forecast, 4) AS forecast FROM direct")
def backtest_direct(spark: SparkSession, sf: str) -> DataFrame:
    return direct(spark, sf).withColumns({"day": iso("day"), "forecast": r("forecast")})


FROZEN = f"""{DIRECT}, frozen AS (
  SELECT p.series_id, f.fold, p.day, p.y, c + phi * p.before AS forecast
  FROM folds f JOIN model m ON m.series_id = f.series_id AND m.fold = f.fold
  JOIN (
    SELECT *, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM pairs) p ON p.series_id = f.series_id AND p.day BETWEEN f.test_start AND f.test_end)"""


@query("backtest_frozen", f"WITH {FROZEN} SELECT series_id, fold, {DAY}, y, round(forecast, 4) AS forecast FROM frozen")
def backtest_with_frozen_models(spark: SparkSession, sf: str) -> DataFrame:
    """The coefficients of a fold's training days, the state renewed with every test day."""
    rows = stored_panel(spark, sf).select("series_id", "day", "y")
    folds = folds_last(day_span(rows, KEYS), KEYS)
    models = fold_models(rows, folds, KEYS, "y", [[1]], difference=False)
    tested = backtest_frozen(rows, folds, models, KEYS, "y", [[1]])
    return tested.select("series_id", "fold", iso("day").alias("day"), "y", r("forecast").alias("forecast"))


@query("backtest_selected")
def backtest_selected(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of the frozen and the direct protocol per fold, orders and differencing chosen on each fold's training days."""
    rows = stored_panel(spark, sf).select("series_id", "day", "y")
    folds = folds_every(day_span(rows, KEYS), KEYS)
    models = materialise(spark, fold_models(rows, folds, KEYS, "y"), "models")
    frozen = backtest_frozen(rows, folds, models, KEYS, "y", name="frozen")
    ahead = foldfits.backtest_direct(rows, folds, models, KEYS, "y", name="direct").drop("y")
    both = frozen.join(ahead, ["series_id", "fold", "day"])
    errors = both.groupBy("series_id", "fold").agg(*[F.avg(F.abs(F.col(n) - F.col("y"))).alias(f"{n}_mae") for n in ("frozen", "direct")])
    return errors.join(models.select("series_id", "fold", "d", F.concat_ws(",", "lags").alias("lags")), ["series_id", "fold"])


@query(
    "backtest_summary",
    f"""WITH {DIRECT}, per_fold AS (
      SELECT series_id, fold, avg(abs(forecast - y)) AS mae,
        avg(CASE WHEN {BAND.format('y')} = {BAND.format('forecast')} THEN 1.0 ELSE 0.0 END) FILTER (WHERE y IS NOT NULL) AS accuracy
      FROM direct GROUP BY 1, 2)
    SELECT series_id, count(*) AS sessions, round(avg(mae), 4) AS mae, round(avg(accuracy), 6) AS accuracy
    FROM per_fold GROUP BY 1""",
)
def backtest_summary(spark: SparkSession, sf: str) -> DataFrame:
    tested = direct(spark, sf)
    hit = F.when(band(F.col("y")) == band(F.col("forecast")), 1.0).when(F.col("y").isNotNull(), 0.0)
    per_fold = tested.groupBy("series_id", "fold").agg(
        F.avg(F.abs(F.col("forecast") - F.col("y"))).alias("mae"), F.avg(hit).alias("accuracy")
    )
    means = average_over(per_fold, ["mae", "accuracy"], KEYS)
    return means.withColumns({"mae": r("mae"), "accuracy": r("accuracy", 6)})


@query(
    "next_day_features",
    f"""WITH {AR1}, {LAST.format('full_panel')},
    profile AS (
      SELECT series_id, avg(y_max) AS y_max, avg(n) AS n FROM full_panel f JOIN spans USING (series_id)
      WHERE day >= last_day - 30 GROUP BY 1),
    future AS (
      SELECT l.series_id, l.last_day + 1 AS day,
        m.intercept / (1 - phi) + phi * (l.y - m.intercept / (1 - phi)) AS y, p.y_max, p.n, 1 AS step
      FROM model m JOIN last l USING (series_id) JOIN profile p USING (series_id)),
    joined AS (
      SELECT series_id, day, y, y_max, n, 0 AS step FROM full_panel UNION ALL SELECT * FROM future),
    made AS (
      SELECT *, lag(y, 1) OVER w AS y_lag_1, lag(y_max, 7) OVER w AS y_max_lag_7, y - lag(y, 1) OVER w AS y_diff_1d,
        avg(y) OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS y_rolling_mean_3d
      FROM joined {W})
    SELECT series_id, {DAY}, CAST(month(day) AS INTEGER) AS month, CAST(isodow(day) - 1 AS INTEGER) AS day_of_week,
      round(sin(2 * pi() * month(day) / 12), 6) + 0.0 AS month_sin, round(y, 4) AS y, round(y_max, 4) AS y_max,
      round(y_lag_1, 4) AS y_lag_1, round(y_max_lag_7, 4) AS y_max_lag_7, round(y_diff_1d, 4) + 0.0 AS y_diff_1d,
      round(y_rolling_mean_3d, 4) AS y_rolling_mean_3d, round(y * y_max, 2) AS y_x_y_max
    FROM made WHERE step = 1""",
)
def next_day_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_panel(spark, sf)
    spec = FeatureSpec(KEYS, "y", ["y", "y_max", "n"], pairs={"y_x_y_max": ("y", "y_max")})
    means = forecast_first_order(rows, fit_first_order(rows, KEYS, "y"), KEYS, "y", 1)
    future = future_rows(rows, means, spec, 1, profile_days=30)
    made = future_features(rows, future, spec)
    values = ["y", "y_max", "y_lag_1", "y_max_lag_7", "y_diff_1d", "y_rolling_mean_3d"]
    return made.select(
        "series_id",
        iso("day").alias("day"),
        "month",
        "day_of_week",
        r("month_sin", 6).alias("month_sin"),
        *[r(c).alias(c) for c in values],
        r("y_x_y_max", 2).alias("y_x_y_max"),
    )


@query(
    "daily_slice",
    f"""WITH {OBS}, days AS (
      SELECT series_id, CAST(ts AS DATE) AS day, round(avg(value), 4) AS y, min(value) AS y_min, max(value) AS y_max
      FROM obs GROUP BY 1, 2),
    made AS (
      SELECT *, lag(y, 1) OVER w AS x, lag(y, 7) OVER w AS y_lag_7, lead(y) OVER w AS target,
        CASE WHEN count(y) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 3
          THEN avg(y) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS y_rolling_mean_3d
      FROM days WINDOW w AS (PARTITION BY series_id ORDER BY day)),
    model AS (SELECT series_id, regr_slope(y, x) AS phi, regr_intercept(y, x) AS intercept FROM made GROUP BY 1)
    SELECT series_id, count(*) AS days, round(avg(abs(intercept + phi * y - target)), 4) AS ar_mae,
      round(avg(abs(y_lag_7 - target)), 4) AS week_mae, round(avg(abs(y_rolling_mean_3d - target)), 4) AS rolling_mae
    FROM made JOIN model USING (series_id) WHERE target IS NOT NULL GROUP BY 1""",
)
def daily_slice(spark: SparkSession, sf: str) -> DataFrame:
    """Scan, daily aggregate, window features, AR(1) next-day forecast and error per series."""
    days = daily(obs(spark, sf), {"value": ["mean", "min", "max"]})
    days = days.select("series_id", "day", F.round("value_mean", 4).alias("y"))
    made = window_features(days, ["y"], KEYS, lags=[1, 7], windows=[3], statistics=["mean"], difference=False)
    made = next_day(made, {"target": "y"}, KEYS)
    model = fit_first_order(days, KEYS, "y")
    scored = made.join(model.select("series_id", "phi", "intercept"), KEYS).where(F.col("target").isNotNull())
    ahead = F.col("intercept") + F.col("phi") * F.col("y")

    def gap(value: Column) -> Column:
        return r(F.avg(F.abs(value - F.col("target"))))

    return scored.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("days"),
        gap(ahead).alias("ar_mae"),
        gap(F.col("y_lag_7")).alias("week_mae"),
        gap(F.col("y_rolling_mean_3d")).alias("rolling_mae"),
    )

"""Daily refits of the selected order, models per fold, and the frozen and direct protocols, against plain loops."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.autoreg import (
    LAG_SETS,
    all_lags,
    best_lag_sets,
    extended_sums,
    fit,
    fit_moving,
    forecast_moving,
    order_grid,
    refit_selected,
    saved_sums,
    select_model,
    solved_sums,
)
from panelcast.operators.foldfits import backtest_direct, backtest_frozen, fitted_in_fold, fold_models
from panelcast.operators.folds import folds_last
from panelcast.operators.resample import day_span

KEYS = ["series_id"]
START = date(2022, 1, 1)
DAYS = 200


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(23)
    y = np.zeros(DAYS)
    for t in range(DAYS):
        y[t] = 10 + 0.5 * (y[t - 1] - 10 if t else 0) + 0.3 * (y[t - 7] - 10 if t >= 7 else 0) + rng.normal()
    return {"a": y, "walk": 40 + np.cumsum(rng.normal(size=DAYS))}


def frame(spark, values):
    rows = [(name, START + timedelta(days=t), float(v)) for name, y in values.items() for t, v in enumerate(y)]
    return spark.createDataFrame([*rows, ("tiny", START, 7.0)], "series_id string, day date, y double")


@pytest.fixture(scope="module")
def panel(spark, values):
    return frame(spark, values).cache()


def regression(y, lags, depth):
    design = np.column_stack([np.ones(len(y) - depth)] + [y[depth - k : len(y) - k] for k in lags])
    beta, *_ = np.linalg.lstsq(design, y[depth:], rcond=None)
    gap = y[depth:] - design @ beta
    return beta, float(gap @ gap), len(gap)


def best_set(y, sets, depth):
    scored = []
    for i, lags in enumerate(sets):
        beta, rss, n = regression(y, lags, depth)
        if n >= len(lags) + 3:
            scored.append((n * math.log(rss / n) + 2 * (len(lags) + 1), i, beta))
    return min(scored)


def test_the_grid_holds_every_order_once():
    grid = order_grid()
    assert len(grid) == 18 and len({tuple(s) for s in grid}) == 18
    assert [] in grid and [1, 2, 3, 4, 5, 7, 14] in grid and [7] in grid and [1, 2, 7, 14] in grid


def test_one_elimination_equals_separate_fits():
    rng = np.random.default_rng(5)
    widest, depth = all_lags(LAG_SETS), 14
    many = []
    for _ in range(40):
        size = int(rng.integers(20, 90))
        y = np.cumsum(rng.normal(size=size)) * rng.uniform(0.1, 1) + rng.normal(size=size) * 3 + rng.uniform(-50, 50)
        x = np.column_stack([np.ones(size - depth)] + [y[depth - k : size - k] for k in widest])
        t = y[depth:]
        many.append((y, (x.T @ x)[np.triu_indices(8)], x.T @ t, t @ t, len(t)))
    found, beta, rss, aic = best_lag_sets(*(np.array([m[i] for m in many]) for i in (4, 1, 2, 3)), LAG_SETS, widest)
    for k, (y, *_) in enumerate(many):
        score, number, want = best_set(y, LAG_SETS, depth)
        assert math.isclose(aic[k], score, rel_tol=1e-6, abs_tol=1e-6)
        used = [0, *[1 + widest.index(lag) for lag in LAG_SETS[found[k]]]]
        if found[k] == number:
            assert np.allclose(beta[k][used], want, rtol=1e-5, atol=1e-7)
        assert set(np.flatnonzero(beta[k])) <= set(used)
    short = best_lag_sets(np.array([2]), many[0][1][None], many[0][2][None], np.array([many[0][3]]), LAG_SETS, widest)
    assert short[0].tolist() == [-1]


def test_a_column_that_others_span_is_refused():
    y = np.arange(60.0)  # every lag is the value less a constant
    x = np.column_stack([np.ones(46)] + [y[14 - k : 60 - k] for k in all_lags()])
    t = y[14:]
    found, beta, rss, _ = best_lag_sets(np.array([46]), (x.T @ x)[np.triu_indices(8)][None], (x.T @ t)[None], np.array([t @ t]), LAG_SETS, all_lags())
    assert len(LAG_SETS[found[0]]) == 1 and rss[0] < 1e-6 * (t @ t) and np.isfinite(beta).all()


def test_daily_refit_equals_a_fit_a_day(spark, panel, values):
    chosen = {"a": ([1, 7], 0), "walk": ([1, 2], 1), "tiny": ([1], 0)}
    model = spark.createDataFrame([(k, lags, d) for k, (lags, d) in chosen.items()], "series_id string, lags array<int>, d int")
    got = {(r.series_id, r.day): r.forecast for r in refit_selected(panel, model, KEYS, "y").collect()}
    assert len(got) == 2 * DAYS + 1
    for name, y in values.items():
        lags, d = chosen[name]
        series = np.diff(y) if d else y
        for t in range(DAYS):
            past, depth = series[: max(t - d, 0)], 14
            if len(past) - depth < len(lags) + 3:
                assert got[name, START + timedelta(days=t)] is None
                continue
            beta, _, _ = regression(past, lags, depth)
            want = beta[0] + sum(b * past[-k] for b, k in zip(beta[1:], lags, strict=True)) + (y[t - 1] if d else 0)
            assert math.isclose(got[name, START + timedelta(days=t)], want, rel_tol=1e-7), (name, t)
    assert got["tiny", START] is None


def test_daily_refit_of_some_days_and_gaps(spark, panel):
    gap = START + timedelta(days=150)
    holes = panel.withColumn("y", F.when(F.col("day") != F.lit(gap), F.col("y")))
    model = select_model(holes, KEYS, "y")
    late = F.col("day") >= F.lit(START + timedelta(days=145))
    some = refit_selected(holes, model, KEYS, "y", days=late)
    every = refit_selected(holes, model, KEYS, "y").where(late)
    rows = {(r.series_id, r.day): r.forecast for r in some.collect()}
    assert rows == {(r.series_id, r.day): r.forecast for r in every.collect()} and len(rows) == 2 * 55
    assert rows["a", gap] is not None and rows["a", gap + timedelta(days=1)] is not None


@pytest.fixture(scope="module")
def folds(panel):
    known = panel.where(F.col("series_id") != "tiny")
    return folds_last(day_span(known, KEYS), KEYS, folds=3, test_days=12, train_days=100)


def test_fold_models_equal_models_of_the_days_before(panel, folds, values):
    got = {(r.series_id, r.fold): r for r in fold_models(panel, folds, KEYS, "y").collect()}
    ends = {(r.series_id, r.fold): r.train_end for r in folds.collect()}
    assert set(got) == set(ends) and len(got) == 6
    for fold in (1, 2, 3):
        before = panel.where(F.col("day") <= F.lit(ends["a", fold]))
        for want in select_model(before, KEYS, "y").collect():
            if want.series_id == "tiny":
                continue
            own = got[want.series_id, fold]
            assert (own.d, own.n, own.lags) == (want.d, want.n, want.lags)
            assert np.allclose(own.coefficients, want.coefficients, rtol=1e-6, atol=1e-8)


def test_frozen_equals_a_loop(panel, folds, values):
    models = fold_models(panel, folds, KEYS, "y")
    by_fold = {(r.series_id, r.fold): r for r in models.collect()}
    got = backtest_frozen(panel, folds, models, KEYS, "y").collect()
    assert len(got) == 2 * 36
    for row in got:
        y, model, t = values[row.series_id], by_fold[row.series_id, row.fold], (row.day - START).days
        past = np.diff(y)[: t - 1] if model.d else y[:t]
        want = model.coefficients[0] + sum(b * past[-k] for b, k in zip(model.coefficients[1:], all_lags(), strict=True)) + (y[t - 1] if model.d else 0)
        assert math.isclose(row.forecast, want, rel_tol=1e-9)


def test_direct_equals_a_loop(panel, folds, values):
    models = fold_models(panel, folds, KEYS, "y")
    by_fold = {(r.series_id, r.fold): r for r in models.collect()}
    ends = {(r.series_id, r.fold): r.train_end for r in folds.collect()}
    got = backtest_direct(panel, folds, models, KEYS, "y").collect()
    assert len(got) == 2 * 36
    for row in got:
        y, model, end = values[row.series_id], by_fold[row.series_id, row.fold], ends[row.series_id, row.fold]
        known = y[: (end - START).days + 1]
        path, total = list(np.diff(known) if model.d else known), known[-1]
        for _ in range((row.day - end).days):
            step = model.coefficients[0] + sum(b * path[-k] for b, k in zip(model.coefficients[1:], all_lags(), strict=True))
            path.append(step)
            total = total + step if model.d else step
        assert math.isclose(row.forecast, total, rel_tol=1e-9)


def test_nothing_after_the_fold_changes_its_model_or_its_direct_forecast(spark, panel, folds, values):
    first = min(r.test_start for r in folds.collect())
    other = frame(spark, {k: np.where(np.arange(DAYS) >= (first - START).days, -99.0, y) for k, y in values.items()})
    last = folds.where("fold = 1")

    def plain(rows, *names):
        return sorted(tuple(str(r[n]) for n in names) for r in rows.collect())

    a, b = (fold_models(p, last, KEYS, "y") for p in (panel, other))
    names = ["series_id", "fold", "d", "lags", "coefficients"]
    assert plain(a, *names) == plain(b, *names)
    made = [backtest_direct(p, last, m, KEYS, "y") for p, m in ((panel, a), (other, b))]
    assert plain(made[0], "series_id", "day", "forecast") == plain(made[1], "series_id", "day", "forecast")


def test_fitted_values_of_a_fold(panel, folds, values):
    model = fold_models(panel, folds, KEYS, "y").where("fold = 2").drop("fold")
    by_series = {r.series_id: r for r in model.collect()}
    for row in fitted_in_fold(panel, model, KEYS, "y").where(F.col("day") >= F.lit(START + timedelta(days=30))).collect():
        y, own, t = values[row.series_id], by_series[row.series_id], (row.day - START).days
        past = np.diff(y)[: t - 1] if own.d else y[:t]
        want = own.coefficients[0] + sum(b * past[-k] for b, k in zip(own.coefficients[1:], all_lags(), strict=True)) + (y[t - 1] if own.d else 0)
        assert math.isclose(row.fitted, want, rel_tol=1e-9)


def test_saved_sums_extended_equal_those_of_all_days(spark, panel):
    lags, cut = [1, 7], F.lit(START + timedelta(days=150))
    saved = saved_sums(panel.where((F.col("day") < cut) & (F.col("series_id") != "walk")), KEYS, "y", lags)
    late = panel.where((F.col("day") >= cut) | (F.col("series_id") == "walk"))
    overlapping = late.unionByName(panel.where((F.col("series_id") == "a") & (F.col("day") < cut)))  # days that were saved before
    extended = extended_sums(saved, overlapping, KEYS, "y", lags)
    got = {r.series_id: r for r in solved_sums(extended, KEYS, 3).collect()}
    for want in fit(panel, KEYS, "y", lags).collect():
        own = got[want.series_id]
        assert own.n == want.n or want.series_id == "tiny"
        if want.coefficients:
            assert np.allclose(own.coefficients, want.coefficients, rtol=1e-9) and math.isclose(own.rss, want.rss, rel_tol=1e-6)
    again = {r.series_id: r.recent for r in extended.collect()}
    assert again == {r.series_id: r.recent for r in saved_sums(panel, KEYS, "y", lags).collect()}


def test_moving_average_terms_are_recovered(spark):
    rng = np.random.default_rng(1)
    rows, truth = [], {"p": (0.6, 0.5), "q": (-0.4, 0.7)}
    for name, (phi, theta) in truth.items():
        e = rng.normal(size=6000)
        y = np.zeros(6000)
        for t in range(1, 6000):
            y[t] = 2 + phi * y[t - 1] + e[t] + theta * e[t - 1]
        rows += [(name, START + timedelta(days=t), float(v)) for t, v in enumerate(y)]
    both = spark.createDataFrame(rows, "series_id string, day date, y double")
    model, errors = fit_moving(both, KEYS, "y", [1], [1])
    found = {r.series_id: r.coefficients for r in model.collect()}
    for name, (phi, theta) in truth.items():
        assert abs(found[name][1] - phi) < 0.05 and abs(found[name][2] - theta) < 0.05
    last = {r.series_id: (r.y, r.error) for r in errors.where(F.col("day") == F.lit(START + timedelta(days=5999))).collect()}
    ahead = forecast_moving(errors, model, KEYS, "y", [1], [1], 3).orderBy("step").collect()
    for name in truth:
        (y, e), (c, phi, theta) = last[name], found[name]
        want = [c + phi * y + theta * e]
        want += [c + phi * want[0]]
        want += [c + phi * want[1]]
        assert np.allclose([r.forecast for r in ahead if r.series_id == name], want, rtol=1e-9)

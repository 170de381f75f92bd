from __future__ import annotations

import math
from dataclasses import replace
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators.autoreg import (
    dickey_fuller,
    LAG_SETS,
    all_lags,
    fit,
    fit_first_order,
    fitted_selected,
    forecast,
    forecast_drivers,
    forecast_first_order,
    forecast_selected,
    refit_each_day,
    refit_selected,
    select_lags,
    select_model,
)
from panelcast.operators.cluster import choose_k, fit_labels, nearest_centre, score_candidates, silhouette
from panelcast.operators.folds import backtest_first_order, folds_every, folds_last, folds_or_split
from panelcast.operators.forests import apply_keeping_gaps, class_weights, fit_classifier
from panelcast.operators.frames import next_day
from panelcast.operators.resample import day_span
from panelcast.operators.scaling import Scaler, fit_scaler
from panelcast.plans.evaluation import backtest_average, backtest_models, evaluate_range, evaluation_scores, save_evaluation
from panelcast.plans.features import FeatureSpec, build_features
from panelcast.plans.forecasting import forecast_days, forecast_from, forecast_report, future_features, future_rows
from panelcast.plans.training import TrainSpec, split_parts, train_bundle, train_if_missing
from panelcast.session import fresh_path

DAYS = 420
START = date(2022, 1, 1)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(7)
    out = {}
    for name, scale in (("a", 1.0), ("b", 2.5)):
        y = np.zeros(DAYS)
        for t in range(DAYS):
            y[t] = 10 + 0.5 * (y[t - 1] - 10 if t else 0) + 0.3 * (y[t - 7] - 10 if t >= 7 else 0) + scale * rng.normal()
        x = rng.normal(size=DAYS) * 5 + 50
        out[name] = (y, x)
    return out


@pytest.fixture(scope="module")
def panel(spark, series):
    rows = [
        (name, START + timedelta(days=t), float(y[t]), float(x[t]), float(y[t] + 4), float(y[t] - 3), float(t % 10))
        for name, (y, x) in series.items()
        for t in range(DAYS)
    ]
    rows.append(("tiny", START, 7.0, 1.0, 8.0, 6.0, 0.0))
    schema = "series_id string, day date, y double, x double, high double, low double, cloud double"
    return spark.createDataFrame(rows, schema)


def least_squares(y, lags, exog=None, depth=None):
    depth = depth or max([1, *lags])
    columns = [np.ones(len(y) - depth)] + [y[depth - k : len(y) - k] for k in lags]
    if exog is not None:
        columns.append(exog[depth:])
    design = np.column_stack(columns)
    beta, *_ = np.linalg.lstsq(design, y[depth:], rcond=None)
    gap = y[depth:] - design @ beta
    return beta, float(gap @ gap), len(gap)


def test_fit_equals_least_squares(panel, series):
    got = {r.series_id: r for r in fit(panel, ["series_id"], "y", [1, 7], ["x"]).collect()}
    for name, (y, x) in series.items():
        beta, rss, n = least_squares(y, [1, 7], x)
        assert np.allclose(got[name].coefficients, beta, rtol=1e-6) and got[name].n == n
        assert math.isclose(got[name].rss, rss, rel_tol=1e-6)


def test_short_series_repeats_its_last_value(panel):
    model = fit(panel, ["series_id"], "y", [1, 7])
    ahead = forecast(panel, model, ["series_id"], "y", [1, 7], 3).where(F.col("series_id") == "tiny").orderBy("step").collect()
    assert [(r.day, r.forecast) for r in ahead] == [(START + timedelta(days=i), 7.0) for i in (1, 2, 3)]


def test_selected_lags_have_the_best_aic(panel, series):
    got = {r.series_id: r for r in select_lags(panel, ["series_id"], "y").collect()}
    for name, (y, _) in series.items():
        scores = {}
        for lags in LAG_SETS:
            _, rss, n = least_squares(y, lags, depth=14)
            scores[tuple(lags)] = n * math.log(rss / n) + 2 * (len(lags) + 1)
        best = min(scores, key=scores.get)
        assert tuple(got[name].lags) == best and math.isclose(got[name].aic, scores[best], rel_tol=1e-6)


def test_recursive_forecast_equals_a_loop(panel, series):
    model = select_lags(panel, ["series_id"], "y")
    beta = {r.series_id: r.coefficients for r in model.collect()}
    ahead = forecast(panel, model, ["series_id"], "y", all_lags(), 7).orderBy("step").collect()
    for name, (y, _) in series.items():
        path = list(y)
        for _ in range(7):
            path.append(beta[name][0] + sum(b * path[-k] for b, k in zip(beta[name][1:], all_lags(), strict=True)))
        assert np.allclose([r.forecast for r in ahead if r.series_id == name], path[-7:], rtol=1e-9)


def test_a_random_walk_is_differenced(spark, panel, series):
    rng = np.random.default_rng(11)
    walk = 50 + np.cumsum(rng.normal(size=DAYS))
    rows = [("walk", START + timedelta(days=t), float(walk[t])) for t in range(DAYS)]
    both = spark.createDataFrame(rows, "series_id string, day date, y double").unionByName(
        panel.where(F.col("series_id") == "a").select("series_id", "day", "y")
    )
    model = select_model(both, ["series_id"], "y")
    chosen = {r.series_id: r for r in model.collect()}
    assert (chosen["walk"].d, chosen["a"].d) == (1, 0)
    ahead = forecast_selected(both, model, ["series_id"], "y", 5).orderBy("step").collect()
    fitted = {(r.series_id, r.day): (r.y, r.fitted) for r in fitted_selected(both, model, ["series_id"], "y").collect()}
    for name, values in (("walk", np.diff(walk)), ("a", series["a"][0])):
        beta, path = chosen[name].coefficients, list(values)
        for _ in range(5):
            path.append(beta[0] + sum(b * path[-k] for b, k in zip(beta[1:], all_lags(), strict=True)))
        want = path[-5:] if name == "a" else walk[-1] + np.cumsum(path[-5:])
        assert np.allclose([r.forecast for r in ahead if r.series_id == name], want, rtol=1e-9)
        t = DAYS - 1
        last = beta[0] + sum(b * values[-1 - k] for b, k in zip(beta[1:], all_lags(), strict=True))
        value, got = fitted[(name, START + timedelta(days=t))]
        assert math.isclose(got, last if name == "a" else walk[t - 1] + last, rel_tol=1e-9)
        assert math.isclose(value, walk[t] if name == "walk" else values[t])


def test_forecast_uses_the_drivers_of_each_step(panel, series):
    model = fit(panel, ["series_id"], "y", [1], ["x"])
    drivers = panel.select("series_id").distinct().select(
        "series_id", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("step")
    ).select("series_id", F.date_add(F.lit(START), F.col("step") + DAYS - 1).alias("day"), (F.col("step") * 10.0).alias("x"))
    beta = {r.series_id: r.coefficients for r in model.collect()}
    ahead = forecast(panel, model, ["series_id"], "y", [1], 3, drivers, ["x"]).orderBy("step").collect()
    for name, (y, _) in series.items():
        value, want = y[-1], []
        for i in (1, 2, 3):
            value = beta[name][0] + beta[name][1] * value + beta[name][2] * 10.0 * i
            want.append(value)
        assert np.allclose([r.forecast for r in ahead if r.series_id == name], want, rtol=1e-9)


def test_driver_forecast_falls_back(panel):
    with_empty = panel.withColumn("none", F.lit(None).cast("double"))
    ahead = forecast_drivers(with_empty, ["series_id"], ["x", "none"], 7)
    tiny = ahead.where(F.col("series_id") == "tiny").collect()
    assert len(tiny) == 7 and {r.x for r in tiny} == {1.0} and {r["none"] for r in tiny} == {0.0}


def test_first_order_path_and_refit(panel, series):
    model = fit_first_order(panel, ["series_id"], "y")
    ahead = forecast_first_order(panel, model, ["series_id"], "y", 5).orderBy("step").collect()
    daily = {(r.series_id, r.day): r.forecast for r in refit_each_day(panel, ["series_id"], "y").collect()}
    for name, (y, _) in series.items():
        (c, phi), _, _ = least_squares(y, [1])
        value, want = y[-1], []
        for _ in range(5):
            value = c + phi * value
            want.append(value)
        assert np.allclose([r.forecast for r in ahead if r.series_id == name], want, rtol=1e-8)
        for t in (10, 31, 100, 400):
            got = daily[(name, START + timedelta(days=t))]
            if t < 31:
                assert got is None
            else:
                (c, phi), _, _ = least_squares(y[:t], [1])
                assert math.isclose(got, c + phi * y[t - 1], rel_tol=1e-8)


def test_backtest_equals_a_fit_per_fold(panel, series):
    known = panel.where(F.col("series_id") != "tiny").select("series_id", "day", "y")
    folds = folds_last(day_span(known, ["series_id"]), ["series_id"], folds=3, test_days=10, train_days=100)
    got = {(r.series_id, r.day): r for r in backtest_first_order(known, folds, ["series_id"], "y").collect()}
    assert len(got) == 2 * 30
    for name, (y, _) in series.items():
        for fold, begin in enumerate((DAYS - 30, DAYS - 20, DAYS - 10), 1):
            (c, phi), _, _ = least_squares(y[:begin], [1])
            value = y[begin - 1]
            for t in range(begin, begin + 10):
                value = c + phi * value
                row = got[(name, START + timedelta(days=t))]
                assert row.fold == fold and math.isclose(row.forecast, value, rel_tol=1e-7)


def test_folds_follow_the_rules(spark):
    lengths = [1, 2, 100, 366, 400, 665, 700, 759, 760, 800, 2000]
    rows = [(n, START, START + timedelta(days=n - 1)) for n in lengths]
    spans = spark.createDataFrame(rows, "series_id int, first_day date, last_day date")

    def positions(folds):
        out = {n: [] for n in lengths}
        for r in folds.orderBy("series_id", "fold").collect():
            assert r.train_end < r.test_start <= r.test_end and r.train_start == START
            out[r.series_id].append(((r.test_start - START).days, (r.test_end - START).days + 1))
        for windows in out.values():
            assert all(a[1] <= b[0] for a, b in zip(windows, windows[1:]))
        return out

    last = positions(folds_last(spans, ["series_id"]))
    every = positions(folds_every(spans, ["series_id"]))
    either = positions(folds_or_split(spans, ["series_id"]))
    for n in lengths:
        first = max(365, n - 300)
        starts = [first + 30 * i for i in range(10)]
        assert last[n] == [(s, min(s + 30, n)) for s in starts if s < n]
        assert every[n] == [(s, s + 60) for s in range(365, n, 60) if s + 60 <= n]
        if n >= 760:
            count = min(10, (n - 730) // 30)
            assert either[n] == [(n - 30 * i, n - 30 * i + 30) for i in range(count, 0, -1)]
        else:
            cut = int(n * 0.8)
            assert either[n] == ([(cut, n)] if 0 < cut < n else [])


def points(spark):
    rng = np.random.default_rng(3)
    centres = [(0.0, 0.0), (8.0, 1.0), (1.0, 9.0)]
    rows = [(i, *(float(v) for v in rng.normal(c, 1.0)), k) for i, (k, c) in enumerate([(k, c) for k, c in enumerate(centres) for _ in range(40)])]
    rows.append((999, 30.0, 30.0, 3))
    return rows, spark.createDataFrame(rows, "id int, u double, v double, label int")


def test_silhouette_equals_all_pairs(spark):
    rows, df = points(spark)
    xy, labels = np.array([r[1:3] for r in rows]), np.array([r[3] for r in rows])
    distance = ((xy[:, None, :] - xy[None, :, :]) ** 2).sum(axis=2)
    total = 0.0
    for i, k in enumerate(labels):
        own = labels == k
        if own.sum() == 1:
            continue
        a = distance[i][own].sum() / (own.sum() - 1)
        b = min(distance[i][labels == other].mean() for other in set(labels) - {k})
        total += (b - a) / max(a, b)
    assert math.isclose(silhouette(df, ["u", "v"], "label").first()[0], total / len(rows), rel_tol=1e-9)


def test_k_is_found_and_centres_assign(spark):
    _, df = points(spark)
    body = df.where(F.col("label") < 3)
    assert choose_k(score_candidates(body, ["u", "v"], range(2, 6))) == 3
    assert choose_k([]) == 3 and choose_k([(4, 0.5), (3, 0.5)]) == 3
    label = nearest_centre(["u", "v"], [(0, [0.0, 0.0]), (1, [8.0, 1.0]), (2, [1.0, 9.0])])
    assert body.where(label != F.col("label")).count() == 0
    model = fit_labels(body.drop("label"), ["u", "v"], k=3)
    gaps = body.withColumn("u", F.when(F.col("id") > 0, F.col("u")))
    scored = apply_keeping_gaps(model, gaps.drop("label"), "label")
    assert scored.where(F.col("label").isNull()).count() == 1
    again = fit_labels(body.drop("label"), ["u", "v"], k=3).stages[-1].clusterCenters()
    assert all(np.allclose(a, b) for a, b in zip(model.stages[-1].clusterCenters(), again, strict=True))


def test_scaler_uses_population_deviation(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    scaler = fit_scaler(df, ["a", "b"])
    assert sorted(map(tuple, scaler.apply(df).collect())) == [(-1.0, 0.0), (1.0, 0.0)]
    again = Scaler.from_table(scaler.to_table(spark), ["b", "a"])
    assert list(again.means) == ["b", "a"] and again.deviations["a"] == 1.0
    with pytest.raises(ValueError):
        Scaler.from_table(scaler.to_table(spark), ["a", "c"])


def test_classifier_beats_the_majority(spark):
    _, df = points(spark)
    body = df.where(F.col("label") < 3)
    weights = {r.label: r.weight for r in class_weights(body, "label").collect()}
    assert all(math.isclose(w, 1.0) for w in weights.values())
    model = fit_classifier(body, ["u", "v"], "label", trees=10, depth=4)
    scored = apply_keeping_gaps(model, body, "predicted_label")
    assert scored.where(F.col("label") == F.col("predicted_label")).count() > 0.95 * body.count()


SPEC = FeatureSpec(["series_id"], "y", ["y", "x", "cloud"], pairs={"y_x_x": ("y", "x")}, poly=["y", "x"])
TRAIN = TrainSpec(["y", "x"], "high", "low", "cloud", k=3, trees=5, depth=5, high_low_depth=5)


def test_forecast_row_equals_the_row_once_it_is_history(panel):
    cut = START + timedelta(days=DAYS - 1)
    body = panel.where(F.col("series_id") != "tiny").select("series_id", "day", "y", "x", "cloud")
    history = body.where(F.col("day") < F.lit(cut))
    known = body.where(F.col("day") == F.lit(cut)).withColumn("step", F.lit(1))
    ahead = future_features(history, known, SPEC).select("series_id", *SPEC.columns).orderBy("series_id").toPandas()
    later = build_features(body, SPEC).where(F.col("day") == F.lit(cut)).select("series_id", *SPEC.columns)
    later = later.orderBy("series_id").toPandas()
    assert np.allclose(ahead[SPEC.columns].astype(float), later[SPEC.columns].astype(float))


def test_future_rows_profile_or_carry(panel):
    means = forecast_first_order(panel, fit_first_order(panel, ["series_id"], "y"), ["series_id"], "y", 2)
    carried = future_rows(panel, means, SPEC, 2).where(F.col("series_id") == "a").orderBy("step").collect()
    assert {r.cloud for r in carried} == {float((DAYS - 1) % 10)}
    profile = future_rows(panel, means, SPEC, 2, profile_days=9).where(F.col("series_id") == "a").collect()
    assert {round(r.cloud, 6) for r in profile} == {4.5}


@pytest.fixture(scope="module")
def bundle(spark, panel):
    return train_bundle(spark, panel, SPEC, TRAIN)


def test_week_ahead(panel, bundle):
    rows = forecast_days(panel, bundle, SPEC, TRAIN, 7, ["x"]).where(F.col("series_id") != "tiny")
    got = rows.orderBy("series_id", "step").collect()
    assert [(r.series_id, r.step) for r in got] == [(s, i) for s in "ab" for i in range(1, 8)]
    assert all(r.minimum < r.maximum and r.condition for r in got)
    text = forecast_report(rows, ["series_id"]).first()
    assert text.date.startswith("2023-") and text.max_text.count(".") == 1


def test_past_range_keeps_days_without_features(spark, panel, bundle):
    start, end = START + timedelta(days=DAYS - 5), START + timedelta(days=DAYS + 1)
    results = evaluate_range(panel, bundle, SPEC, TRAIN, start, end)
    saved = save_evaluation(spark, results, fresh_path(spark, "test-evaluation"), start)
    got = saved.where(F.col("series_id") == "a").orderBy("day").collect()
    assert len(got) == 7 and got[-1].actual_mean is None and got[-1].predicted_condition == "N/A"
    assert got[0].actual_mean is not None and got[0].predicted_mean is not None
    scores = evaluation_scores(results, [0, 1, 2])
    assert scores["mean"].first().n == 10 and 0 <= scores["accuracy"].first().accuracy <= 1


def test_bundle_is_trained_once(spark, panel):
    path = fresh_path(spark, "test-bundle")
    _, trained = train_if_missing(spark, path, panel, SPEC, TRAIN)
    loaded, again = train_if_missing(spark, path, panel, SPEC, TRAIN)
    assert trained and not again and loaded.complete
    wider = replace(SPEC, lags=[1, 2])
    assert forecast_from(spark, path, panel, SPEC, TRAIN, 2).count() == 6
    _, other = train_if_missing(spark, path, panel, wider, TRAIN)
    assert other


def test_backtest_of_models(spark, panel):
    known = panel.where(F.col("series_id") != "tiny")
    scores = backtest_models(spark, known, SPEC, TRAIN, test_days=25, train_days=345)
    got = scores.orderBy("fold").collect()
    assert [(r.fold, r.days) for r in got] == [(1, 50), (2, 50), (3, 50)]
    assert all(0.5 < r.accuracy <= 1 and r.mean_mae < 5 and r.maximum_mae < 5 for r in got)
    average = backtest_average(scores).first()
    assert average.sessions == 3 and math.isclose(average.mean_mae, sum(r.mean_mae for r in got) / 3)


def test_a_fold_sees_nothing_of_its_test_days(spark, panel):
    """Other values on the test days leave the training rows, and the mean forecasts of the test rows, as they are."""
    known = panel.where(F.col("series_id") != "tiny")
    cut = START + timedelta(days=380)
    fold = day_span(known, ["series_id"]).select(
        "series_id",
        F.lit(1).alias("fold"),
        F.col("first_day").alias("train_start"),
        F.date_sub(F.lit(cut), 1).alias("train_end"),
        F.lit(cut).alias("test_start"),
        F.col("last_day").alias("test_end"),
    )
    late = F.col("day") >= F.lit(cut)
    other = known.withColumns({c: F.when(late, F.col(c) * -3 + 7).otherwise(F.col(c)) for c in ("y", "x", "high", "low", "cloud")})
    parts = [split_parts(spark, rows, fold, SPEC, TRAIN) for rows in (known, other)]

    def plain(rows, names):
        return sorted(tuple(str(r[n]) for n in names) for r in rows.collect())

    train = [plain(p[0], sorted(p[0].columns)) for p in parts]
    assert train[0] == train[1] and len(train[0]) > 600
    ahead = [plain(p[1], ["series_id", "day", "mean_forecast"]) for p in parts]
    assert ahead[0] == ahead[1] and len(ahead[0]) == 80


def test_past_days_are_forecast_by_the_selected_order(spark, panel, bundle):
    start, end = START + timedelta(days=DAYS - 3), START + timedelta(days=DAYS - 1)
    got = {(r.series_id, r.day): r.predicted_mean for r in evaluate_range(panel, bundle, SPEC, TRAIN, start, end).collect()}
    days = F.col("day").between(F.lit(start), F.lit(end))
    want = refit_selected(panel, bundle.tables["forecaster"], ["series_id"], "y", days=days).collect()
    assert len(want) == 6 and all(got[r.series_id, r.day] == r.forecast for r in want)


def test_label_of_the_next_day(spark):
    df = spark.createDataFrame([("a", START + timedelta(days=i), i) for i in range(3)], "series_id string, day date, label int")
    got = next_day(df, {"label": "label"}, ["series_id"]).orderBy("day").collect()
    assert [r.label for r in got] == [1, 2, None]


def test_unit_root_test_survives_exact_series(spark):
    shapes = {"straight": lambda i: 2.0 * i, "constant": lambda i: 5.0, "alternating": lambda i: float(i % 2), "short": lambda i: float(i * i)}
    rows = [(k, date(2024, 1, 1) + timedelta(days=i), f(i)) for k, f in shapes.items() for i in range(3 if k == "short" else 40)]
    panel = spark.createDataFrame(rows, "series_id string, day date, y double")
    found = {r.series_id: r.t_value for r in dickey_fuller(panel, ["series_id"], "y").collect()}
    assert found == dict.fromkeys(shapes)
    assert select_model(panel, ["series_id"], "y").count() == len(shapes)


def test_silhouette_of_awkward_labellings(spark):
    schema = "x double, label int"
    same = spark.createDataFrame([(1.0, 0), (1.0, 0), (1.0, 1), (1.0, 1)], schema)
    assert silhouette(same, ["x"], "label").first()[0] == 0.0
    apart = [(0.0, 0), (0.0, 0), (9.0, 1), (9.0, 1)]
    gaps = spark.createDataFrame([*apart, (5.0, None), (7.0, None), (None, 0)], schema)
    assert silhouette(gaps, ["x"], "label").first()[0] == 1.0

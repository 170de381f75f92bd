from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelcast.functions.dates import with_calendar
from panelcast.functions.physics import clip, destination_point, dew_point, polynomial
from panelcast.functions.present import describe_label, fixed_decimals
from panelcast.operators.clean import align, completeness, drop_empty_columns, fill_mean, to_number, trailing_days
from panelcast.operators.combine import join_or_fall_back, stack, widen_regions
from panelcast.operators.frames import best_candidate, carry_forward, carry_gaps, last_rows, window_features
from panelcast.operators.resample import chunks_of, daily, daily_mean, diurnal_offsets, fill_gaps, position
from panelcast.operators.scores import accuracy, classification_report, confusion_matrix, regression_scores
from panelcast.sources.writers import nan_to_null
from tests.test_sources import plan


@pytest.fixture(scope="module")
def clean(hourly):
    return nan_to_null(hourly)


@pytest.fixture(scope="module")
def frame(hourly_rows):
    names = ["series_id", "ts", "temperature", "precipitation", "code"]
    return pd.DataFrame(hourly_rows, columns=names).astype({"temperature": float})


def close(a, b):
    if a is None or (isinstance(a, float) and math.isnan(a)):
        return b is None or math.isnan(b)
    return b is not None and math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)


def test_daily_equals_pandas_resample(clean, frame):
    spec = {"temperature": ["mean", "min", "max", "first"], "precipitation": ["sum"], "code": ["last"]}
    got = fill_gaps(daily(clean, spec), ["series_id"])
    got = {(r.series_id, r.day): r for r in got.collect()}
    for series, part in frame.groupby("series_id"):
        want = part.set_index("ts").resample("D").agg(
            {"temperature": ["mean", "min", "max", "first"], "precipitation": ["sum"], "code": ["last"]}
        )
        assert len(want) == sum(1 for k in got if k[0] == series)
        for day, row in want.iterrows():
            mine = got[(series, day.date())]
            for name in ("mean", "min", "max", "first"):
                assert close(row[("temperature", name)], mine[f"temperature_{name}"])
            if mine["precipitation_sum"] is not None:  # a gap day holds NULL here and 0 in pandas
                assert close(row[("precipitation", "sum")], mine["precipitation_sum"])
            assert close(float(row[("code", "last")]), None if mine["code_last"] is None else float(mine["code_last"]))


def test_day_without_values_sums_to_zero(clean):
    got = daily(clean, {"temperature": ["sum", "mean"]}).where(F.col("day") == "2021-01-15").first()
    assert got.temperature_sum == 0.0 and got.temperature_mean is None


def test_daily_mean_leaves_out_empty_days(clean):
    days = {r.day for r in daily_mean(clean, "temperature").where(F.col("series_id") == "a").collect()}
    assert date(2021, 1, 10) not in days and date(2021, 1, 15) not in days and date(2021, 1, 3) in days


def test_window_features_equal_pandas_and_do_not_leak(clean):
    days = fill_gaps(daily(clean, {"temperature": ["mean"]}), ["series_id"])
    got = window_features(days, ["temperature_mean"], ["series_id"]).orderBy("series_id", "day").toPandas()
    part = window_features(days, ["temperature_mean"], ["series_id"], full=False).orderBy("series_id", "day").toPandas()
    for _, rows in got.groupby("series_id"):
        y = rows["temperature_mean"].reset_index(drop=True)
        loose = part.loc[rows.index].reset_index(drop=True)
        rows = rows.reset_index(drop=True)
        for k in (1, 2, 3, 7, 14, 30):
            assert np.allclose(rows[f"temperature_mean_lag_{k}"], y.shift(k), equal_nan=True)
        for w in (3, 7):
            for name in ("mean", "min", "max", "std"):
                column = f"temperature_mean_rolling_{name}_{w}d"
                assert np.allclose(rows[column], getattr(y.rolling(w), name)(), equal_nan=True)
                assert np.allclose(loose[column], getattr(y.rolling(w, min_periods=1), name)(), equal_nan=True)
        assert np.allclose(rows["temperature_mean_diff_1d"], y.diff(), equal_nan=True)


def test_gap_fill_and_windows_share_one_exchange_by_series(clean):
    days = fill_gaps(daily(clean, {"temperature": ["mean"]}), ["series_id"])
    text = plan(window_features(days, ["temperature_mean"], ["series_id"]))
    # one exchange for the daily aggregate, one for everything by series
    assert text.split("(1) ")[0].count("Exchange") == 2


def test_iso_week_and_leap_day(spark):
    df = spark.createDataFrame([(date(2021, 1, 3),), (date(2024, 2, 29),)], "day date")
    first, leap = with_calendar(df).orderBy("day").collect()
    assert (first.week_of_year, first.day_of_week, first.season_Winter) == (53, 6, 1)
    assert (leap.day_of_year, leap.month) == (60, 2)


def test_positions_across_uneven_days(spark):
    rows = spark.range(5000).select(
        F.lit("s").alias("series_id"),
        F.when(F.col("id") < 4000, F.lit("2024-01-02")).otherwise(F.lit("2024-01-01")).cast("date").alias("day"),
        F.col("id"),
    )
    got = position(rows, ["series_id"], ["day", "id"], F.col("day")).select("id", "pos").collect()
    want = {i: i + 1000 for i in range(4000)} | {i: i - 4000 for i in range(4000, 5000)}
    assert {r.id: r.pos for r in got} == want


def test_chunks_drop_the_incomplete_one(clean, frame):
    got = chunks_of(clean, {"precipitation": ["sum"]}).where(F.col("series_id") == "b").orderBy("chunk").collect()
    values = frame[frame.series_id == "b"].precipitation.to_numpy()
    assert [r.precipitation_sum for r in got] == [values[i * 24 : i * 24 + 24].sum() for i in range(len(values) // 24)]
    assert chunks_of(clean, {"precipitation": ["sum"]}).where(F.col("series_id") == "c").count() == 0


def test_offsets_default(spark):
    rows = [("a", date(2024, 1, 1), 10.0, 13.0, 8.0), ("a", date(2024, 1, 2), 10.0, 15.0, 9.0), ("b", date(2024, 1, 1), None, None, None)]
    df = spark.createDataFrame(rows, "s string, day date, y double, hi double, lo double")
    got = {r.s: (r.up, r.down) for r in diurnal_offsets(df, ["s"], "y", "hi", "lo").collect()}
    assert got == {"a": (4.0, 1.5), "b": (5.0, 5.0)}


def test_trailing_and_tail(spark):
    df = spark.createDataFrame([("a", date(2024, 1, 1) + timedelta(days=2 * i), i) for i in range(30)], "s string, day date, v int")
    assert trailing_days(df, ["s"], 30).agg(F.min("v")).first()[0] == 14
    assert sorted(r.v for r in last_rows(df, 3, ["s"]).collect()) == [27, 28, 29]


def test_carry(spark):
    rows = [("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 2), None), ("a", date(2024, 1, 3), 3.0), ("a", date(2024, 1, 4), None)]
    df = spark.createDataFrame(rows, "s string, day date, v double")
    assert [r.v for r in carry_gaps(df, ["v"], ["s"]).orderBy("day").collect()] == [1.0, 1.0, 3.0, 3.0]
    ahead = carry_forward(df, ["v"], ["s"], 2).orderBy("step").collect()
    assert [(r.day, r.v) for r in ahead] == [(date(2024, 1, 5), 3.0), (date(2024, 1, 6), 3.0)]


def test_fill_mean_of_a_series_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", None)], "s string, v double")
    got = sorted((r.s, r.v) for r in fill_mean(df, ["v"], ["s"]).collect() if r.v is not None)
    assert got == [("a", 1.0), ("a", 2.0), ("a", 3.0)]


def test_contract_and_numbers(spark):
    df = spark.createDataFrame([("x", 1, "2.5"), ("y", None, "bad")], "k string, n int, t string")
    got = align(to_number(df, ["t"]), {"t": "double", "absent": "double", "n": "int"}, keep=["k"])
    assert got.columns == ["k", "t", "absent", "n"]
    assert sorted(map(tuple, got.collect())) == [("x", 2.5, 0.0, 1), ("y", 0.0, 0.0, 0)]
    assert drop_empty_columns(df.withColumn("e", F.lit(None).cast("double"))).columns == ["k", "n", "t"]
    assert {r.column_name: r.non_null for r in completeness(df, ["k", "n"]).collect()} == {"k": 2, "n": 1}


def test_fallback_join(spark):
    basic = spark.createDataFrame([("both", 1, 1.0), ("both", 2, 2.0), ("left", 1, 3.0)], "s string, t int, a double")
    advanced = spark.createDataFrame([("both", 2, 9.0), ("both", 3, 8.0), ("right", 5, 7.0)], "s string, t int, b double")
    got = {(r.s, r.t): (r.a, r.b) for r in join_or_fall_back(basic, advanced, "s", "t").collect()}
    assert got == {("both", 2): (2.0, 9.0), ("left", 1): (3.0, None), ("right", 5): (None, 7.0)}


def test_regions_beside_the_centre(spark):
    centre = spark.createDataFrame([("c", date(2024, 1, d), float(d)) for d in (1, 2)], "series_id string, day date, v double")
    regions = spark.createDataFrame([("N", date(2024, 1, 1), 5.0), ("S", date(2024, 1, 2), None)], "series_id string, day date, v double")
    got = {r.day.day: (r.N_v, r.S_v) for r in widen_regions(centre, regions, ["N", "S"], ["v"]).collect()}
    assert got == {1: (5.0, None), 2: (None, None)}


def test_stack_fills_absent_columns(spark):
    a, b = spark.createDataFrame([(1, 2)], "x int, y int"), spark.createDataFrame([(3,)], "x int")
    assert sorted(map(tuple, stack(a, b).collect()), key=str) == [(1, 2), (3, None)]


def test_physics(spark):
    row = spark.range(1).select(
        dew_point(F.lit(20.0), F.lit(50.0)).alias("d"),
        dew_point(F.lit(20.0), F.lit(150.0)).alias("full"),
        clip(F.lit(None).cast("double"), 1, 2).alias("none"),
        destination_point(F.lit(28.6448), F.lit(77.2167), F.lit(500.0), F.lit(0.0))[0].alias("north"),
        destination_point(F.lit(0.0), F.lit(10.0), F.lit(500.0), F.lit(90.0))[1].alias("east"),
    ).first()
    gamma = 17.27 * 20 / 257.7 + math.log(0.5)
    assert math.isclose(row.d, 237.7 * gamma / (17.27 - gamma), rel_tol=1e-12)
    assert math.isclose(row.full, 20.0, rel_tol=1e-9) and row.none is None
    assert math.isclose(row.north, 28.6448 + math.degrees(500 / 6371), rel_tol=1e-9)
    assert math.isclose(row.east, 10 + math.degrees(500 / 6371), rel_tol=1e-9)
    assert list(polynomial(["a", "b"])) == ["a", "b", "a_x_a", "a_x_b", "b_x_b"]


def test_presentation(spark):
    df = spark.createDataFrame([(1.25, 0), (None, 9), (-0.5, None)], "v double, k int")
    got = [(r.a, r.b) for r in df.select(fixed_decimals(F.col("v"), 1).alias("a"), describe_label(F.col("k")).alias("b")).collect()]
    assert got == [("1.3", "Clear/Sunny"), ("N/A", "Weather Type 9"), ("-0.5", "Unknown")]


def test_first_best_candidate_wins(spark):
    df = spark.createDataFrame([("a", 3, 0.5), ("a", 4, 0.9), ("a", 5, 0.9), ("a", 6, None), ("b", 3, None)], "s string, k int, score double")
    got = {r.s: r.k for r in best_candidate(df, ["s"], "k", "score").collect()}
    assert got == {"a": 4, "b": None}


# The published confusion counts (actual, predicted, days).
PUBLISHED = [(0, 0, 41), (0, 2, 7), (0, 3, 11), (1, 0, 1), (1, 3, 3), (2, 0, 2), (2, 2, 24), (2, 3, 6), (3, 2, 11), (3, 3, 43)]


def test_scores_on_the_published_counts(spark):
    rows = [(a, p) for a, p, n in PUBLISHED for _ in range(n)] + [(None, 1), (2, None)]
    df = spark.createDataFrame(rows, "a int, p int")
    got = accuracy(df, "a", "p").first()
    assert got.n == 149 and math.isclose(got.accuracy, 108 / 149)
    report = {r.label: r for r in classification_report(df, "a", "p").collect()}
    assert report["1"].precision == 0.0 and report["1"].recall == 0.0 and report["1"].support == 4
    assert math.isclose(report["0"].precision, 41 / 44) and math.isclose(report["0"].recall, 41 / 59)
    assert math.isclose(report["weighted avg"].recall, 108 / 149) and report["macro avg"].support == 149
    f1 = [report[k].f1 for k in "0123"]
    assert math.isclose(report["macro avg"].f1, sum(f1) / 4)
    matrix = {r.actual: [r[f"predicted_{k}"] for k in range(4)] for r in confusion_matrix(df, "a", "p", [0, 1, 2, 3]).collect()}
    assert matrix == {0: [41, 0, 7, 11], 1: [1, 0, 0, 3], 2: [2, 0, 24, 6], 3: [0, 0, 11, 43]}


def test_confusion_row_of_a_label_only_predicted(spark):
    df = spark.createDataFrame([(0, 1), (0, 0)], "a int, p int")
    assert {r.actual: r.predicted_0 for r in confusion_matrix(df, "a", "p", [0, 1]).collect()} == {0: 1, 1: 0}


def test_regression_scores(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 0.0), (None, 5.0)], "a double, p double")
    got = regression_scores(df, "a", "p").first()
    assert (got.n, got.mae, got.bias) == (2, 1.5, -0.5) and math.isclose(got.rmse, math.sqrt(2.5))

"""The wide feature chain on arrays against the same chain by columns and against loops."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from panelcast.operators.frames import window_features
from panelcast.operators.wide import beside_regions, daily_values, value_names, window_arrays, window_names
from panelcast.plans.wide import WideSpec, fit_on_wide, training_vectors, wide_features

START = datetime(2022, 1, 1)
VARIABLES = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "cloud_cover", "rain", "wind_direction_10m", "snow_depth"]
SPEC = WideSpec(VARIABLES, ["N", "E"], pairs={"wind_x_cloud": ("wind_speed_10m_mean", "cloud_cover_mean")}, powers=["temperature_2m_mean", "wind_speed_10m_mean"])


@pytest.fixture(scope="module")
def hours(spark):
    rng = np.random.default_rng(4)
    rows = []
    for series in ("a", "b", "c"):
        for day in range(45):
            if series == "b" and day == 20:
                continue  # a gap day
            for hour in (0, 6, 12, 18):
                values = [float(v) for v in rng.normal(20, 4, len(VARIABLES))]
                values[0] = None if (series, day) == ("a", 30) else values[0]
                rows.append((series, START + timedelta(days=day, hours=hour), *values))
    schema = "series_id string, ts timestamp_ntz, " + ", ".join(f"{v} double" for v in VARIABLES)
    return spark.createDataFrame(rows, schema).cache()


@pytest.fixture(scope="module")
def neighbours(spark):
    return spark.createDataFrame([("a", 0, "b"), ("a", 1, "c"), ("b", 0, "a"), ("b", 1, "nowhere")], "centre string, slot int, series_id string")


def test_names_and_places_agree(hours, neighbours):
    assert len(SPEC.columns) == len(set(SPEC.columns))
    rows = wide_features(hours, neighbours, SPEC)
    assert rows.where(F.size("features") != len(SPEC.columns)).count() == 0
    assert rows.groupBy("series_id").count().where("count <> 45").count() == 0


def test_a_region_stands_in_its_slot(hours, neighbours):
    days = daily_values(hours, SPEC.aggregates)
    width = len(value_names(SPEC.aggregates))
    own = {(r.series_id, r.day): r["values"] for r in days.collect()}
    for row in beside_regions(days, neighbours, 2, width).collect():
        slots = {"a": ["b", "c"], "b": ["a", None], "c": [None, None]}[row.series_id]
        want = [v for s in slots for v in own.get((s, row.day), [None] * width)]
        assert row["values"] == own[row.series_id, row.day] and row.around == want


def test_windows_equal_those_by_column(spark, hours):
    names = SPEC.levels
    days = daily_values(hours, SPEC.aggregates)
    at = {n: i for i, n in enumerate(value_names(SPEC.aggregates))}
    levels = F.array(*[F.get("values", F.lit(at[n])) for n in names])
    made = window_arrays(days, levels, ["series_id"], size=len(names))
    made = {(r.series_id, r.day): [*r.lagged, *r.rolled, *r.changed] for r in made.collect()}
    columns = days.select("series_id", "day", *[F.get("values", F.lit(at[n])).alias(n) for n in names])
    for row in window_features(columns, names, ["series_id"], full=False).collect():
        want = [row[n] for n in window_names(names)]
        got = made[row.series_id, row.day]
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)) for a, b in zip(got, want, strict=True))


def test_a_forest_reads_the_array(hours, neighbours):
    vectors = training_vectors(wide_features(hours, neighbours, SPEC))
    # b lacks a region and c both, so only a has complete rows; the first month lacks its lags
    got = {(r.series_id, r.n) for r in vectors.groupBy("series_id").agg(F.count("*").alias("n")).collect()}
    assert {s for s, _ in got} <= {"a"}
    plain = training_vectors(wide_features(hours, neighbours.limit(0), WideSpec(VARIABLES, [], lags=[1, 2])))
    assert plain.count() > 90
    model = fit_on_wide(plain, [RandomForestRegressor(numTrees=5, maxDepth=3, seed=1, featuresCol="scaled", labelCol="target")])
    assert model.transform(plain).where(F.col("prediction").isNull()).count() == 0

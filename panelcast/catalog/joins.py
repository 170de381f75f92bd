"""Joins, unions and positions on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import (
    FULL,
    GRADED,
    OBS,
    STATUS,
    graded,
    iso,
    obs,
    r,
    status_days,
    stored_panel,
    table,
)
from panelcast.catalog.registry import query
from panelcast.operators.autoreg import seasonal_naive
from panelcast.operators.combine import (
    common_keys,
    forecast_beside_actual,
    join_or_fall_back,
    join_sources,
    label_union,
    rows_in_common,
    stack,
    widen_regions,
    with_bearings,
)
from panelcast.operators.resample import daily
from panelcast.schema import REGION_BEARINGS, REGION_DISTANCE_KM

DAY = "strftime({0}day, '%Y-%m-%d') AS day"
KEYS = ["series_id", "day"]


@query(
    "join_inner_ts",
    f"""WITH {STATUS} SELECT b.series_id, {DAY.format('b.')}, price, quantity
    FROM basic b JOIN advanced a ON a.series_id = b.series_id AND a.day = b.day""",
)
def join_inner_ts(spark: SparkSession, sf: str) -> DataFrame:
    return join_sources(*status_days(spark, sf), KEYS).withColumn("day", iso("day"))


@query(
    "join_fallback",
    f"""WITH {STATUS}, merged AS (
      SELECT coalesce(b.series_id, a.series_id) AS series_id, coalesce(b.day, a.day) AS day, price, quantity,
        b.series_id IS NOT NULL AND a.series_id IS NOT NULL AS both_sides
      FROM basic b FULL JOIN advanced a ON a.series_id = b.series_id AND a.day = b.day)
    SELECT series_id, {DAY.format('')}, price, quantity FROM merged
    WHERE both_sides OR series_id NOT IN (SELECT series_id FROM basic)
      OR series_id NOT IN (SELECT series_id FROM advanced)""",
)
def join_fallback(spark: SparkSession, sf: str) -> DataFrame:
    basic, advanced = status_days(spark, sf)
    return join_or_fall_back(basic, advanced, "series_id", "day").withColumn("day", iso("day"))


REGIONS = ["click", "error", "purchase", "signup"]


@query(
    "join_regions_wide",
    f"""WITH {OBS}, daily AS (
      SELECT series_id, CAST(ts AS DATE) AS day, round(avg(value), 8) AS value_mean, max(value) AS value_max
      FROM obs GROUP BY 1, 2)
    SELECT c.series_id, {DAY.format('c.')}, c.value_mean, c.value_max, """
    + ", ".join(f"{k}.value_mean AS {k}_value_mean, {k}.value_max AS {k}_value_max" for k in REGIONS)
    + " FROM daily c "
    + " ".join(f"LEFT JOIN daily {k} ON {k}.day = c.day AND {k}.series_id = '{k}'" for k in REGIONS)
    + " WHERE c.series_id = 'view'",
)
def join_regions_wide(spark: SparkSession, sf: str) -> DataFrame:
    days = daily(obs(spark, sf), {"value": ["mean", "max"]}).withColumn("value_mean", F.round("value_mean", 8))
    centre = days.where(F.col("series_id") == "view")
    regions = days.where(F.col("series_id") != "view")
    return widen_regions(centre, regions, REGIONS, ["value_mean", "value_max"]).withColumn("day", iso("day"))


@query(
    "semi_join_dates",
    f"""WITH {STATUS} SELECT series_id, {DAY.format('')}, price FROM basic b
    WHERE EXISTS (SELECT 1 FROM advanced a WHERE a.series_id = b.series_id AND a.day = b.day)""",
)
def semi_join_dates(spark: SparkSession, sf: str) -> DataFrame:
    return rows_in_common(*status_days(spark, sf), KEYS).withColumn("day", iso("day"))


@query(
    "intersect_dates",
    f"""WITH {STATUS}, c AS (SELECT series_id, day FROM basic INTERSECT SELECT series_id, day FROM advanced)
    SELECT series_id, {DAY.format('')} FROM c""",
)
def intersect_dates(spark: SparkSession, sf: str) -> DataFrame:
    return common_keys(*status_days(spark, sf), KEYS).withColumn("day", iso("day"))


@query(
    "join_forecast_actual",
    f"""WITH {FULL}, forecasts AS (
      SELECT series_id, day, coalesce(lag(y, 7) OVER w, lag(y, 1) OVER w) AS forecast FROM panel
      WINDOW w AS (PARTITION BY series_id ORDER BY day))
    SELECT d.series_id, {DAY.format('d.')}, p.y AS actual, f.forecast FROM days d
    LEFT JOIN panel p ON p.series_id = d.series_id AND p.day = d.day
    LEFT JOIN forecasts f ON f.series_id = d.series_id AND f.day = d.day""",
)
def join_forecast_actual(spark: SparkSession, sf: str) -> DataFrame:
    full = stored_panel(spark, sf)
    known = full.where(F.col("y").isNotNull())
    actual = known.select(*KEYS, F.col("y").alias("actual"))
    forecast = seasonal_naive(known.select(*KEYS, "y"), ["series_id"], "y")
    forecast = forecast.select(*KEYS, F.col("naive").alias("forecast"))
    return forecast_beside_actual(full.select(*KEYS), actual, forecast, KEYS).withColumn("day", iso("day"))


BEARING_ROWS = ", ".join(f"('{n}', CAST({b} AS DOUBLE))" for n, b in REGION_BEARINGS.items())
POINT = """degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(bearing))))"""
TURN = """degrees(radians(lon) + atan2(sin(radians(bearing)) * sin(d) * cos(radians(lat)),
    cos(d) - sin(radians(lat)) * sin(radians(latitude))))"""


@query(
    "cross_bearings",
    f"""WITH bearings(region, bearing) AS (VALUES {BEARING_ROWS}),
    centres AS (SELECT s_suppkey, s_acctbal / 250 AS lat, s_nationkey * 7.0 AS lon, 500.0 / 6371.0 AS d FROM supplier),
    spread AS (SELECT *, {POINT} AS latitude FROM centres CROSS JOIN bearings)
    SELECT s_suppkey, region, bearing, round(latitude, 6) AS latitude, round({TURN}, 6) AS longitude FROM spread""",
)
def cross_bearings(spark: SparkSession, sf: str) -> DataFrame:
    centres = table(spark, sf, "supplier")
    lat, lon = F.col("s_acctbal") / 250, F.col("s_nationkey") * F.lit(7.0)
    points = with_bearings(centres, lat, lon, F.lit(REGION_DISTANCE_KM), REGION_BEARINGS)
    return points.select("s_suppkey", "region", "bearing", r("latitude", 6).alias("latitude"), r("longitude", 6).alias("longitude"))


@query(
    "union_all",
    f"""WITH {STATUS} SELECT series_id, {DAY.format('')}, price, CAST(NULL AS DOUBLE) AS quantity FROM basic
    UNION ALL SELECT series_id, {DAY.format('')}, NULL, quantity FROM advanced""",
)
def union_all(spark: SparkSession, sf: str) -> DataFrame:
    return stack(*status_days(spark, sf)).withColumn("day", iso("day"))


@query(
    "label_union",
    f"""WITH {GRADED} SELECT actual_label AS label FROM graded WHERE actual_label IS NOT NULL
    UNION SELECT predicted_label FROM graded WHERE predicted_label IS NOT NULL""",
)
def labels_of_both(spark: SparkSession, sf: str) -> DataFrame:
    return label_union(graded(spark, sf), ["actual_label", "predicted_label"])

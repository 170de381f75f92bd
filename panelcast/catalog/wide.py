"""The wide feature chain on the given tables: every kind of event is a centre, the others are its regions."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import HOURLY, hourly, iso, r
from panelcast.catalog.registry import query
from panelcast.plans.wide import WideSpec, fit_on_wide, training_vectors, wide_features
from panelcast.session import materialise

VARIABLES = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m", "cloud_cover", "precipitation", "weather_code"]
SPEC = WideSpec(
    VARIABLES,
    ["r1", "r2", "r3", "r4"],
    pairs={"temp_x_humidity": ("temperature_2m_mean", "relative_humidity_2m_mean"), "wind_x_cloud": ("wind_speed_10m_mean", "cloud_cover_mean")},
    powers=["temperature_2m_mean", "wind_speed_10m_mean"],
)
#: Named features that are compared with the SQL one by one; of all others the number that are known.
SHOWN = [
    "day_of_week",
    "season_Winter",
    "month_sin",
    "temperature_2m_mean",
    "precipitation_sum",
    "weather_code_last",
    "r1_temperature_2m_mean",
    "r3_wind_speed_10m_max",
    "r4_precipitation_sum",
    "dew_point",
    "temperature_2m_mean_lag_1",
    "cloud_cover_mean_lag_7",
    "temperature_2m_mean_rolling_mean_3d",
    "temperature_2m_mean_rolling_std_7d",
    "precipitation_sum_rolling_max_7d",
    "relative_humidity_2m_mean_rolling_min_3d",
    "wind_speed_10m_mean_diff_1d",
    "temp_x_humidity",
    "temperature_2m_mean_x_wind_speed_10m_mean",
    "temperature_2m_mean_x_temperature_2m_mean",
]


def neighbours(hours: DataFrame) -> DataFrame:
    """All other series of a centre, in the order of their names."""
    series = hours.select("series_id").distinct()
    pairs = series.select(F.col("series_id").alias("centre")).join(series, F.col("centre") != F.col("series_id"))
    listed = pairs.groupBy("centre").agg(F.array_sort(F.collect_list("series_id")).alias("_all"))
    return listed.select("centre", F.posexplode("_all").alias("slot", "series_id"))


def rows_of(spark: SparkSession, sf: str, spec: WideSpec = SPEC) -> DataFrame:
    hours = materialise(spark, hourly(spark, sf), "hours")
    return wide_features(hours, neighbours(hours), spec)


_ROLL = "OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN {0} PRECEDING AND CURRENT ROW)"
_VALUES = ", ".join(
    f"avg({v}) AS {v}_mean, min({v}) AS {v}_min, max({v}) AS {v}_max" for v in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "cloud_cover")
)
_REGIONS = " ".join(f"LEFT JOIN days r{k} ON r{k}.day = d.day AND r{k}.series_id = d.others[{k}]" for k in (1, 2, 3, 4))
_T, _H, _W, _C = (f"{v}_mean" for v in ("temperature_2m", "relative_humidity_2m", "wind_speed_10m", "cloud_cover"))
_GAMMA = f"(17.27 * {_T} / (237.7 + {_T}) + ln(least(greatest({_H}, 1), 100) / 100))"


@query(
    "wide_features",
    f"""WITH {HOURLY}, met AS (
      SELECT series_id, CAST(ts AS DATE) AS day, {_VALUES}, sum(precipitation) AS precipitation_sum,
        arg_max(weather_code, ts) AS weather_code_last FROM hourly GROUP BY 1, 2),
    calendar AS (
      SELECT series_id, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM met GROUP BY series_id),
    days AS (
      SELECT c.series_id, c.day, m.* EXCLUDE (series_id, day) REPLACE (coalesce(precipitation_sum, 0) AS precipitation_sum)
      FROM calendar c LEFT JOIN met m ON m.series_id = c.series_id AND m.day = c.day),
    others AS (
      SELECT a.series_id, list(b.series_id ORDER BY b.series_id) AS others
      FROM (SELECT DISTINCT series_id FROM days) a JOIN (SELECT DISTINCT series_id FROM days) b ON a.series_id <> b.series_id GROUP BY 1),
    made AS (
      SELECT *, lag({_T}, 1) OVER w AS l1, lag({_C}, 7) OVER w AS l7, avg({_T}) {_ROLL.format(2)} AS m3, stddev_samp({_T}) {_ROLL.format(6)} AS s7,
        max(precipitation_sum) {_ROLL.format(6)} AS x7, min({_H}) {_ROLL.format(2)} AS n3, {_W} - lag({_W}, 1) OVER w AS d1,
        lead({_T}, 1) OVER w AS target
      FROM days WINDOW w AS (PARTITION BY series_id ORDER BY day)),
    d AS (SELECT * FROM made JOIN others USING (series_id))
    SELECT d.series_id, strftime(d.day, '%Y-%m-%d') AS day, {len(SPEC.columns)} AS width, CAST(isodow(d.day) - 1 AS DOUBLE) AS f0,
      CASE WHEN month(d.day) IN (1, 2, 10, 11, 12) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS f1, round(sin(2 * pi() * month(d.day) / 12), 6) + 0.0 AS f2,
      round(d.{_T}, 8) AS f3, round(d.precipitation_sum, 4) AS f4, CAST(d.weather_code_last AS DOUBLE) AS f5,
      round(r1.{_T}, 8) AS f6, r3.wind_speed_10m_max AS f7, round(r4.precipitation_sum, 4) AS f8,
      round(237.7 * {_GAMMA.replace(_T, 'd.' + _T).replace(_H, 'd.' + _H)} / (17.27 - {_GAMMA.replace(_T, 'd.' + _T).replace(_H, 'd.' + _H)}), 6) AS f9,
      round(l1, 8) AS f10, round(l7, 8) AS f11, round(m3, 6) AS f12, round(s7, 6) + 0.0 AS f13, round(x7, 4) AS f14, round(n3, 8) AS f15,
      round(d1, 6) + 0.0 AS f16, round(d.{_T} * d.{_H} / 997, 6) AS f17, round(d.{_T} * d.{_W} / 997, 6) AS f18, round(d.{_T} * d.{_T} / 997, 6) AS f19,
      round(target, 8) AS target
    FROM d {_REGIONS}""",
)
def wide_rows(spark: SparkSession, sf: str) -> DataFrame:
    digits = [6, 6, 6, 8, 4, 6, 8, 6, 4, 6, 8, 8, 6, 6, 4, 8, 6, 6, 6, 6]
    # products are shown in units of 997, see `inputs`
    shown = [r(F.get("features", F.lit(SPEC.place(n))) / (997 if "_x_" in n else 1), d).alias(f"f{i}") for i, (n, d) in enumerate(zip(SHOWN, digits, strict=True))]
    rows = rows_of(spark, sf)
    return rows.select("series_id", iso("day").alias("day"), F.size("features").alias("width"), *shown, r("target", 8).alias("target"))


@query("wide_forecast")
def wide_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """The next day's mean by a forest on all wide features, trained on the days before the last week.

    The given hours span a month, so lags stop at a week.
    """
    vectors = materialise(spark, training_vectors(rows_of(spark, sf, replace(SPEC, lags=[1, 2, 3, 7]))), "wide")
    cutoff = vectors.agg(F.date_sub(F.max("day"), 7)).first()[0] or date(1970, 1, 1)
    forest = RandomForestRegressor(numTrees=20, maxDepth=5, seed=42, featuresCol="scaled", labelCol="target", predictionCol="predicted")
    model = fit_on_wide(vectors.where(F.col("day") < F.lit(cutoff)), [forest])
    return model.transform(vectors.where(F.col("day") >= F.lit(cutoff))).select("series_id", "day", "target", "predicted")

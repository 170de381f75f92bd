"""Daily aggregates, gap days, chunks and profiles on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import (
    FULL,
    HOURLY,
    OBS,
    PANEL,
    USER_OBS,
    full_panel,
    hourly,
    iso,
    iso_ts,
    obs,
    panel,
    r,
    rounded,
    user_obs,
)
from panelcast.catalog.registry import query
from panelcast.functions.present import slice_known
from panelcast.operators.frames import next_day
from panelcast.operators.resample import chunks_of, daily, daily_mean, diurnal_offsets, fill_gaps, trailing_profile
from panelcast.sources.payloads import pack_days

DAY = "strftime(day, '%Y-%m-%d') AS day"


@query(
    "daily_agg_map",
    f"""WITH {OBS} SELECT series_id, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 8) AS value_mean,
    min(value) AS value_min, max(value) AS value_max, round(sum(value), 2) AS amount_sum,
    arg_min(k, ts) AS direction_first, arg_max(k, ts) AS code_last FROM obs GROUP BY 1, 2""",
)
def daily_agg_map(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).withColumns({"amount": F.col("value"), "direction": F.col("k"), "code": F.col("k")})
    spec = {"value": ["mean", "min", "max"], "amount": ["sum"], "direction": ["first"], "code": ["last"]}
    days = daily(rows, spec)
    return days.withColumns({"day": iso("day"), "value_mean": r("value_mean", 8), "amount_sum": r("amount_sum", 2)})


@query(
    "daily_sum_zero",
    f"""WITH {USER_OBS} SELECT series_id, strftime(ts, '%Y-%m-%d') AS day,
    round(coalesce(sum(value), 0), 2) AS value_sum FROM user_obs GROUP BY 1, 2""",
)
def daily_sum_zero(spark: SparkSession, sf: str) -> DataFrame:
    return daily(user_obs(spark, sf), {"value": ["sum"]}).withColumns({"day": iso("day"), "value_sum": r("value_sum", 2)})


@query(
    "daily_first_last",
    f"""WITH {USER_OBS} SELECT series_id, strftime(ts, '%Y-%m-%d') AS day,
    arg_min(value, ts) FILTER (WHERE value IS NOT NULL) AS value_first,
    arg_max(value, ts) FILTER (WHERE value IS NOT NULL) AS value_last FROM user_obs GROUP BY 1, 2""",
)
def daily_first_last(spark: SparkSession, sf: str) -> DataFrame:
    days = daily(user_obs(spark, sf), {"value": ["first", "last"]})
    return days.withColumn("day", iso("day"))


@query(
    "daily_gap_fill",
    f"WITH {FULL} SELECT series_id, {DAY}, y, y_sum FROM full_panel",
)
def daily_gap_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_gaps(panel(spark, sf), ["series_id"]).select("series_id", iso("day").alias("day"), "y", "y_sum")


@query(
    "daily_mean_series",
    f"""WITH {USER_OBS} SELECT series_id, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 5) AS y
    FROM user_obs GROUP BY 1, 2 HAVING count(value) > 0""",
)
def daily_mean_series(spark: SparkSession, sf: str) -> DataFrame:
    return daily_mean(user_obs(spark, sf), "value").withColumns({"day": iso("day"), "y": r("y", 5)})


@query(
    "daily_avg_max_min",
    f"""WITH {USER_OBS} SELECT series_id, strftime(ts, '%Y-%m-%d') AS day, round(avg(value), 5) AS value_mean,
    max(value) AS value_max, min(value) AS value_min, round(avg(k), 5) AS k_mean, max(k) AS k_max, min(k) AS k_min
    FROM user_obs GROUP BY 1, 2""",
)
def daily_avg_max_min(spark: SparkSession, sf: str) -> DataFrame:
    every = ["mean", "max", "min"]
    days = daily(user_obs(spark, sf), {"value": every, "k": every})
    return rounded(days.withColumn("day", iso("day")), ["value_mean", "k_mean"], 5)


@query(
    "chunk_agg_24",
    f"""WITH {HOURLY}, placed AS (
      SELECT *, (row_number() OVER (PARTITION BY series_id ORDER BY ts) - 1) // 24 AS chunk FROM hourly)
    SELECT series_id, chunk, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS chunk_start,
      round(avg(temperature_2m), 8) AS temperature_2m_mean, max(temperature_2m) AS temperature_2m_max,
      round(sum(precipitation), 2) AS precipitation_sum
    FROM placed GROUP BY 1, 2 HAVING count(*) = 24""",
)
def chunk_agg_24(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"temperature_2m": ["mean", "max"], "precipitation": ["sum"]}
    chunks = chunks_of(hourly(spark, sf), spec)
    chunks = chunks.withColumn("chunk_start", iso_ts("chunk_start"))
    return chunks.withColumns(
        {"temperature_2m_mean": r("temperature_2m_mean", 8), "precipitation_sum": r("precipitation_sum", 2)}
    )


@query(
    "next_day_targets",
    f"""WITH {FULL} SELECT series_id, {DAY}, y, lead(y) OVER w AS target, lead(y_max) OVER w AS target_max,
    lead(y_min) OVER w AS target_min FROM full_panel WINDOW w AS (PARTITION BY series_id ORDER BY day)""",
)
def next_day_targets(spark: SparkSession, sf: str) -> DataFrame:
    targets = {"target": "y", "target_max": "y_max", "target_min": "y_min"}
    rows = next_day(full_panel(spark, sf), targets, ["series_id"])
    return rows.select("series_id", iso("day").alias("day"), "y", *targets)


OFFSETS = """ends AS (SELECT series_id, max(day) AS last_day FROM panel GROUP BY 1),
offsets AS (
  SELECT series_id, coalesce(avg(y_max - y), 5.0) AS up, coalesce(avg(y - y_min), 5.0) AS down
  FROM panel JOIN ends USING (series_id) WHERE day >= last_day - 365 GROUP BY 1)"""


@query(
    "diurnal_offsets",
    f"WITH {PANEL}, {OFFSETS} SELECT series_id, round(up, 6) AS up, round(down, 6) AS down FROM offsets",
)
def offsets_of_year(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(diurnal_offsets(panel(spark, sf), ["series_id"], "y", "y_max", "y_min"), ["up", "down"], 6)


@query(
    "trailing_profile",
    f"""WITH {PANEL}, ends AS (SELECT series_id, max(day) AS last_day FROM panel GROUP BY 1)
    SELECT series_id, round(avg(y), 8) AS y, round(avg(y_max), 8) AS y_max, round(avg(n), 8) AS n
    FROM panel JOIN ends USING (series_id) WHERE day >= last_day - 30 GROUP BY 1""",
)
def profile_of_month(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["y", "y_max", "n"]
    return rounded(trailing_profile(panel(spark, sf), ["series_id"], columns), columns, 8)


@query(
    "array_slice_filter",
    f"""WITH {HOURLY}, placed AS (
      SELECT series_id, CAST(ts AS DATE) AS day, hour(ts) AS h, wind_speed_10m,
        CASE WHEN weather_code >= 50 THEN weather_code END AS code,
        row_number() OVER (PARTITION BY series_id, CAST(ts AS DATE) ORDER BY ts) AS rn FROM hourly)
    SELECT series_id, {DAY}, CAST(count(code) AS INTEGER) AS known,
      coalesce(string_agg(CAST(code AS VARCHAR), ',' ORDER BY h), '') AS codes
    FROM placed WHERE rn BETWEEN 7 AND 18 GROUP BY 1, 2""",
)
def array_slice_filter(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf).withColumn("code", F.when(F.col("weather_code") >= 50, F.col("weather_code")))
    packed = pack_days(rows, ["code"]).where(F.size("entries") >= 7)
    codes = slice_known(F.col("entries")["code"], 7, 12)
    return packed.select(
        "series_id",
        iso("day").alias("day"),
        F.size(codes).alias("known"),
        F.array_join(F.transform(codes, lambda c: c.cast("string")), ",").alias("codes"),
    )

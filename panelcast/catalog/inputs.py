"""Stand-ins for the observation tables, built from the given tables, in Spark and in SQL.

Means are expressed in units of 997: dividing by a prime keeps them from ending
exactly between two rounded values, where the engines round differently.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.operators.resample import fill_gaps
from panelcast.session import materialise
from panelcast.sources.tables import read_table


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf}/{name}.parquet")


def r(value: Column | str, digits: int = 4) -> Column:
    """Rounded output, without a negative zero."""
    value = F.col(value) if isinstance(value, str) else value
    return F.round(value, digits) + F.lit(0.0)


def rounded(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    return df.withColumns({c: r(c, digits) for c in columns})


def iso(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd")


def iso_ts(value: Column | str) -> Column:
    return F.date_format(value, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def obs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw observations: one row per event."""
    return table(spark, sf, "events").select(
        "event_id",
        F.col("event_type").alias("series_id"),
        "ts",
        "user_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


OBS = """obs AS (
  SELECT event_id, event_type AS series_id, ts, user_id, value,
         CAST(regexp_extract(props, '[0-9]+') AS INTEGER) AS k
  FROM events)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly table: one row per series and hour."""
    return (
        obs(spark, sf)
        .groupBy("series_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(
            F.round(F.avg("value") * 100 / 997, 4).alias("temperature_2m"),
            F.round(F.avg("k") * 1000 / 997, 4).alias("relative_humidity_2m"),
            F.max("value").alias("wind_speed_10m"),
            F.min("value").alias("cloud_cover"),
            F.round(F.sum("value"), 2).alias("precipitation"),
            F.max("k").alias("weather_code"),
        )
    )


HOURLY = f"""{OBS}, hourly AS (
  SELECT series_id, date_trunc('hour', ts) AS ts,
         round(avg(value) * 100 / 997, 4) AS temperature_2m, round(avg(k) * 1000 / 997, 4) AS relative_humidity_2m,
         max(value) AS wind_speed_10m, min(value) AS cloud_cover,
         round(sum(value), 2) AS precipitation, max(k) AS weather_code
  FROM obs GROUP BY 1, 2)"""


def user_obs(spark: SparkSession, sf: str) -> DataFrame:
    """Raw observations with one series per user and gaps: values of a low k are missing."""
    return (
        obs(spark, sf)
        .withColumn("series_id", F.col("user_id").cast("string"))
        .withColumn("value", F.when(F.col("k") >= 50, F.col("value")))
    )


USER_OBS = f"""{OBS}, user_obs AS (
  SELECT event_id, CAST(user_id AS VARCHAR) AS series_id, ts,
         CASE WHEN k >= 50 THEN value END AS value, k
  FROM obs)"""


def wide_hours(spark: SparkSession, sf: str) -> DataFrame:
    """Hours with one column per event type, NULL where the hour has none."""
    kinds = ["click", "error", "purchase", "signup", "view"]
    return (
        obs(spark, sf)
        .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
        .agg(*[F.round(F.avg(F.when(F.col("series_id") == k, F.col("value"))) * 100 / 997, 4).alias(k) for k in kinds])
    )


WIDE = f"""{OBS}, wide AS (
  SELECT date_trunc('hour', ts) AS ts,
         round(avg(value) FILTER (WHERE series_id = 'click') * 100 / 997, 4) AS click,
         round(avg(value) FILTER (WHERE series_id = 'error') * 100 / 997, 4) AS error,
         round(avg(value) FILTER (WHERE series_id = 'purchase') * 100 / 997, 4) AS purchase,
         round(avg(value) FILTER (WHERE series_id = 'signup') * 100 / 997, 4) AS signup,
         round(avg(value) FILTER (WHERE series_id = 'view') * 100 / 997, 4) AS view
  FROM obs GROUP BY 1)"""


def panel(spark: SparkSession, sf: str) -> DataFrame:
    """Daily panel of orders by priority; days without orders are absent."""
    price = F.col("o_totalprice")
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("day"))
        .agg(
            F.round(F.avg(price) / 997, 4).alias("y"),
            F.round(F.min(price) / 997, 4).alias("y_min"),
            F.round(F.max(price) / 997, 4).alias("y_max"),
            F.round(F.sum(price) / 997, 4).alias("y_sum"),
            F.count(F.lit(1)).cast("int").alias("n"),
        )
    )


PANEL = """panel AS (
  SELECT o_orderpriority AS series_id, CAST(o_orderdate AS DATE) AS day,
         round(avg(o_totalprice) / 997, 4) AS y, round(min(o_totalprice) / 997, 4) AS y_min,
         round(max(o_totalprice) / 997, 4) AS y_max, round(sum(o_totalprice) / 997, 4) AS y_sum,
         CAST(count(*) AS INTEGER) AS n
  FROM orders GROUP BY 1, 2)"""


def full_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel with every calendar day; gap days hold NULL."""
    return fill_gaps(panel(spark, sf), ["series_id"])


FULL = f"""{PANEL}, spans AS (
  SELECT series_id, min(day) AS first_day, max(day) AS last_day FROM panel GROUP BY 1),
days AS (
  SELECT series_id, CAST(unnest(generate_series(first_day, last_day, INTERVAL 1 DAY)) AS DATE) AS day FROM spans),
full_panel AS (
  SELECT d.series_id, d.day, p.y, p.y_min, p.y_max, p.y_sum, p.n
  FROM days d LEFT JOIN panel p ON p.series_id = d.series_id AND p.day = d.day)"""


def stored_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The full panel written once, for queries that use it more than once: the raw rows are read one time."""
    return materialise(spark, full_panel(spark, sf), "panel")


def measures(spark: SparkSession, sf: str) -> DataFrame:
    """Daily panel of line items by return flag with several measures."""
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("series_id"), F.to_date("l_shipdate").alias("day"))
        .agg(
            F.round(F.avg("l_quantity"), 4).alias("temperature"),
            F.round(F.avg("l_discount") * 1000, 4).alias("humidity"),
            F.round(F.avg("l_tax") * 100, 4).alias("wind"),
            F.round(F.avg("l_extendedprice") / 997, 4).alias("cloud"),
            F.round(F.max("l_quantity"), 4).alias("temperature_max"),
            F.round(F.min("l_quantity"), 4).alias("temperature_min"),
            F.round(F.sum("l_quantity"), 4).alias("rain"),
        )
    )


MEASURES = """measures AS (
  SELECT l_returnflag AS series_id, CAST(l_shipdate AS DATE) AS day,
         round(avg(l_quantity), 4) AS temperature, round(avg(l_discount) * 1000, 4) AS humidity,
         round(avg(l_tax) * 100, 4) AS wind, round(avg(l_extendedprice) / 997, 4) AS cloud,
         round(max(l_quantity), 4) AS temperature_max, round(min(l_quantity), 4) AS temperature_min,
         round(sum(l_quantity), 4) AS rain
  FROM lineitem GROUP BY 1, 2)"""


def stored_measures(spark: SparkSession, sf: str) -> DataFrame:
    return materialise(spark, measures(spark, sf), "measures")


def status_days(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two daily sources keyed by status and day; the first knows one status more."""
    basic = (
        table(spark, sf, "orders")
        .groupBy(F.col("o_orderstatus").alias("series_id"), F.to_date("o_orderdate").alias("day"))
        .agg(F.round(F.avg("o_totalprice") / 997, 4).alias("price"))
    )
    advanced = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_linestatus").alias("series_id"), F.to_date("l_shipdate").alias("day"))
        .agg(F.round(F.avg("l_quantity"), 4).alias("quantity"))
    )
    return basic, advanced


STATUS = """basic AS (
  SELECT o_orderstatus AS series_id, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice) / 997, 4) AS price
  FROM orders GROUP BY 1, 2),
advanced AS (
  SELECT l_linestatus AS series_id, CAST(l_shipdate AS DATE) AS day, round(avg(l_quantity), 4) AS quantity
  FROM lineitem GROUP BY 1, 2)"""


def customer_spans(spark: SparkSession, sf: str) -> DataFrame:
    """First and last order day of each customer: many series of different length."""
    return (
        table(spark, sf, "orders")
        .groupBy(F.col("o_custkey").alias("series_id"))
        .agg(F.min(F.to_date("o_orderdate")).alias("first_day"), F.max(F.to_date("o_orderdate")).alias("last_day"))
    )


CUSTOMER_SPANS = """spans AS (
  SELECT o_custkey AS series_id, min(CAST(o_orderdate AS DATE)) AS first_day, max(CAST(o_orderdate AS DATE)) AS last_day
  FROM orders GROUP BY 1)"""


def graded(spark: SparkSession, sf: str) -> DataFrame:
    """Panel days with an actual and a predicted value and label."""
    from panelcast.operators.autoreg import seasonal_naive

    df = seasonal_naive(full_panel(spark, sf), ["series_id"], "y")
    # labels by value band; 0 to 3 for the actual, the naive one for the prediction
    return df.select(
        "series_id",
        "day",
        F.col("y").alias("actual"),
        F.col("naive").alias("predicted"),
        band(F.col("y")).alias("actual_label"),
        band(F.col("naive")).alias("predicted_label"),
    )


def band(value: Column) -> Column:
    return F.when(value < 150, 0).when(value < 250, 1).when(value < 350, 2).when(value.isNotNull(), 3)


BAND = "CASE WHEN {0} < 150 THEN 0 WHEN {0} < 250 THEN 1 WHEN {0} < 350 THEN 2 WHEN {0} IS NOT NULL THEN 3 END"
GRADED = f"""{FULL}, naive AS (
  SELECT series_id, day, y,
         coalesce(lag(y, 7) OVER (PARTITION BY series_id ORDER BY day),
                  lag(y, 1) OVER (PARTITION BY series_id ORDER BY day)) AS naive
  FROM full_panel),
graded AS (
  SELECT series_id, day, y AS actual, naive AS predicted,
         {BAND.format('y')} AS actual_label, {BAND.format('naive')} AS predicted_label
  FROM naive)"""

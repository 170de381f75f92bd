"""Filters, contracts and missing values on the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import FULL, OBS, PANEL, WIDE, full_panel, iso, iso_ts, obs, panel, r, stored_panel, table, wide_hours
from panelcast.catalog.registry import query
from panelcast.functions.dates import with_calendar
from panelcast.functions.present import first_known
from panelcast.operators.clean import (
    align,
    before,
    completeness,
    drop_empty_columns,
    fill_mean,
    to_number,
    trailing_days,
    when_complete,
    with_prefix,
)
from panelcast.operators.frames import slice_rows
from panelcast.sources.tables import in_range, like_prefix

STAMP = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts"
DAY = "strftime(day, '%Y-%m-%d') AS day"
KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "filter_half_open",
    f"""WITH {OBS} SELECT event_id, {STAMP} FROM obs
    WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13'""",
)
def filter_half_open(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).where(in_range(F.col("ts"), date(2024, 1, 10), date(2024, 1, 12)))
    return rows.select("event_id", iso_ts("ts").alias("ts"))


@query(
    "filter_closed",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders
    WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1998-01-01'""",
)
def filter_closed(spark: SparkSession, sf: str) -> DataFrame:
    # order dates are midnights, so the day after the range is admitted
    span = in_range(F.col("o_orderdate"), date(1996, 1, 1), date(1997, 12, 31), inclusive_end=True)
    return table(spark, sf, "orders").where(span).select("o_orderkey", iso("o_orderdate").alias("o_orderdate"))


@query(
    "filter_month_like",
    """SELECT l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate FROM lineitem
    WHERE CAST(l_shipdate AS VARCHAR) LIKE '1997-05-%'""",
)
def filter_month_like(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").where(like_prefix(F.col("l_shipdate"), "1997-05-%"))
    return rows.select("l_orderkey", "l_linenumber", iso("l_shipdate").alias("l_shipdate"))


@query(
    "completeness_profile",
    f"WITH {WIDE} "
    + " UNION ALL ".join(f"SELECT '{k}' AS column_name, count({k}) AS non_null FROM wide" for k in KINDS),
)
def completeness_profile(spark: SparkSession, sf: str) -> DataFrame:
    return completeness(wide_hours(spark, sf), KINDS)


@query(
    "drop_any_null",
    f"""WITH {WIDE} SELECT {STAMP}, click, error, purchase, signup, view FROM wide
    WHERE {' AND '.join(f'{k} IS NOT NULL' for k in KINDS)}""",
)
def drop_any_null(spark: SparkSession, sf: str) -> DataFrame:
    return wide_hours(spark, sf).na.drop("any").withColumn("ts", iso_ts("ts"))


@query(
    "drop_subset_null",
    f"""WITH {WIDE} SELECT {STAMP}, click, error, purchase, signup, view FROM wide
    WHERE click IS NOT NULL AND view IS NOT NULL""",
)
def drop_subset_null(spark: SparkSession, sf: str) -> DataFrame:
    return wide_hours(spark, sf).na.drop(subset=["click", "view"]).withColumn("ts", iso_ts("ts"))


@query("drop_empty_columns", f"WITH {WIDE} SELECT {STAMP}, click, view FROM wide")
def drop_empty(spark: SparkSession, sf: str) -> DataFrame:
    rows = wide_hours(spark, sf).select("ts", "click", "view")
    rows = rows.withColumn("snow_depth", F.when(F.col("click") < 0, F.col("click")))
    return drop_empty_columns(rows).withColumn("ts", iso_ts("ts"))


@query("drop_columns", "SELECT l_orderkey, l_linenumber, l_quantity, l_tax FROM lineitem")
def drop_columns(spark: SparkSession, sf: str) -> DataFrame:
    unwanted = ["l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate"]
    return table(spark, sf, "lineitem").drop(*unwanted, "absent")


@query(
    "align_contract",
    f"""WITH {WIDE} SELECT {STAMP}, coalesce(view, 0) AS view, coalesce(click, 0) AS click,
    CAST(0 AS DOUBLE) AS snow_depth, CAST(trunc(coalesce(error, 0)) AS INTEGER) AS error FROM wide""",
)
def align_contract(spark: SparkSession, sf: str) -> DataFrame:
    rows = wide_hours(spark, sf).withColumn("ts", iso_ts("ts"))
    contract = {"view": "double", "click": "double", "snow_depth": "double", "error": "int"}
    return align(rows, contract, keep=["ts"])


@query(
    "coerce_numeric",
    f"""WITH {OBS} SELECT event_id,
    TRY_CAST(CASE WHEN k < 30 THEN 'missing' WHEN k < 60 THEN CAST(k AS VARCHAR) ELSE CAST(k AS VARCHAR) || 'x' END AS DOUBLE)
    AS reading FROM obs""",
)
def coerce_numeric(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("k").cast("string")
    text = F.when(F.col("k") < 30, F.lit("missing")).when(F.col("k") < 60, k).otherwise(F.concat(k, F.lit("x")))
    return to_number(obs(spark, sf).select("event_id", text.alias("reading")), ["reading"])


@query(
    "fill_const",
    f"WITH {WIDE} SELECT {STAMP}, " + ", ".join(f"coalesce({k}, 0) AS {k}" for k in KINDS) + " FROM wide",
)
def fill_const(spark: SparkSession, sf: str) -> DataFrame:
    return wide_hours(spark, sf).na.fill(0.0).withColumn("ts", iso_ts("ts"))


@query(
    "fill_mean",
    f"""WITH {FULL} SELECT series_id, {DAY},
    round(coalesce(y, avg(y) OVER (PARTITION BY series_id)), 4) AS y,
    round(coalesce(y_max, avg(y_max) OVER (PARTITION BY series_id)), 4) AS y_max FROM full_panel""",
)
def fill_by_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_panel(spark, sf).select("series_id", "day", "y", "y_max")
    filled = fill_mean(rows, ["y", "y_max"], ["series_id"])
    return filled.select("series_id", iso("day").alias("day"), r("y").alias("y"), r("y_max").alias("y_max"))


@query(
    "select_prefix",
    """WITH d AS (SELECT o_orderkey, month(o_orderdate) AS m FROM orders)
    SELECT o_orderkey, CASE WHEN m IN (3, 4) THEN 1 ELSE 0 END AS "season_Spring",
      CASE WHEN m IN (5, 6) THEN 1 ELSE 0 END AS "season_Summer",
      CASE WHEN m IN (1, 2, 10, 11, 12) THEN 1 ELSE 0 END AS "season_Winter" FROM d""",
)
def select_prefix(spark: SparkSession, sf: str) -> DataFrame:
    rows = with_calendar(table(spark, sf, "orders"), "o_orderdate")
    return with_prefix(rows, ["season_"], ["o_orderkey"])


@query(
    "trailing_days",
    f"""WITH {PANEL}, ends AS (SELECT series_id, max(day) AS last_day FROM panel GROUP BY 1)
    SELECT panel.series_id, {DAY}, y FROM panel JOIN ends USING (series_id) WHERE day >= last_day - 30""",
)
def trailing(spark: SparkSession, sf: str) -> DataFrame:
    rows = trailing_days(panel(spark, sf), ["series_id"], 30)
    return rows.select("series_id", iso("day").alias("day"), "y")


@query(
    "history_before",
    f"WITH {PANEL} SELECT series_id, {DAY}, y FROM panel WHERE day < DATE '2000-06-15'",
)
def history_before(spark: SparkSession, sf: str) -> DataFrame:
    rows = before(panel(spark, sf), F.lit(date(2000, 6, 15)))
    return rows.select("series_id", iso("day").alias("day"), "y")


@query(
    "fold_slice",
    f"""WITH {PANEL}, placed AS (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day) - 1 AS pos FROM panel)
    SELECT series_id, {DAY}, y, CAST(pos AS INTEGER) AS pos FROM placed WHERE pos >= 365 AND pos < 425""",
)
def fold_slice(spark: SparkSession, sf: str) -> DataFrame:
    rows = slice_rows(panel(spark, sf), ["series_id"], 365, 425)
    return rows.select("series_id", iso("day").alias("day"), "y", "pos")


@query(
    "score_complete_rows",
    f"""WITH {WIDE} SELECT {STAMP},
    CASE WHEN {' AND '.join(f'{k} IS NOT NULL' for k in KINDS)}
      THEN round(click + 2 * error + 3 * purchase - signup - view, 4) + 0.0 END AS score FROM wide""",
)
def score_complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = {k: F.col(k) for k in KINDS}
    score = c["click"] + 2 * c["error"] + 3 * c["purchase"] - c["signup"] - c["view"]
    return wide_hours(spark, sf).select(iso_ts("ts").alias("ts"), when_complete(KINDS, r(score)).alias("score"))


@query(
    "coalesce_chain",
    f"""WITH {FULL}, held AS (
      SELECT series_id, day, y, last_value(y IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY day
        ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS h FROM full_panel)
    SELECT series_id, {DAY}, coalesce(y, h) AS value FROM held""",
)
def coalesce_chain(spark: SparkSession, sf: str) -> DataFrame:
    from panelcast.operators.frames import by_day

    recent = F.last("y", ignorenulls=True).over(by_day(["series_id"]).rowsBetween(-7, -1))
    rows = full_panel(spark, sf).withColumn("held", recent)
    return rows.select("series_id", iso("day").alias("day"), first_known(F.col("y"), F.col("held")).alias("value"))

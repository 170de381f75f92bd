"""Row-frame features and column functions on the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import (
    CUSTOMER_SPANS,
    FULL,
    MEASURES,
    OBS,
    PANEL,
    customer_spans,
    full_panel,
    iso,
    iso_ts,
    measures,
    obs,
    panel,
    r,
    rounded,
    stored_measures,
    stored_panel,
    table,
)
from panelcast.catalog.registry import query
from panelcast.catalog.resampling import OFFSETS
from panelcast.functions.dates import SEASON_FLAGS, calendar_parts, cyclic, iso_minutes, one_hot, parse_local, season
from panelcast.functions.physics import destination_point, dew_point, interactions, polynomial, spread_from_mean
from panelcast.functions.present import CLASS_NAMES, describe_label
from panelcast.operators.clean import fill_mean
from panelcast.operators.combine import ranked_stack
from panelcast.operators.dedupe import first_per_key
from panelcast.operators.frames import (
    LAGS,
    STATISTICS,
    WINDOWS,
    best_candidate,
    carry_forward,
    future_days,
    last_rows,
    window_features,
)
from panelcast.operators.resample import diurnal_offsets

DAY = "strftime(day, '%Y-%m-%d') AS day"
W = "WINDOW w AS (PARTITION BY series_id ORDER BY day)"
SQL_STATISTICS = {"mean": "avg", "min": "min", "max": "max", "std": "stddev_samp"}


@query(
    "lags",
    f"WITH {FULL} SELECT series_id, {DAY}, "
    + ", ".join(f"lag({c}, {k}) OVER w AS {c}_lag_{k}" for c in ("y", "y_max") for k in LAGS)
    + f" FROM full_panel {W}",
)
def lags(spark: SparkSession, sf: str) -> DataFrame:
    rows = window_features(full_panel(spark, sf), ["y", "y_max"], ["series_id"], windows=[], difference=False)
    made = [f"{c}_lag_{k}" for c in ("y", "y_max") for k in LAGS]
    return rows.select("series_id", iso("day").alias("day"), *made)


def rolling_sql(full: bool) -> str:
    terms = []
    for w in WINDOWS:
        frame = f"OVER (PARTITION BY series_id ORDER BY day ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
        for s in STATISTICS:
            value = f"round({SQL_STATISTICS[s]}(y) {frame}, 6)"
            if full:
                value = f"CASE WHEN count(y) {frame} = {w} THEN {value} END"
            terms.append(f"{value} AS y_rolling_{s}_{w}d")
    return f"WITH {FULL} SELECT series_id, {DAY}, " + ", ".join(terms) + " FROM full_panel"


def rolling(spark: SparkSession, sf: str, full: bool) -> DataFrame:
    rows = window_features(full_panel(spark, sf), ["y"], ["series_id"], lags=[], full=full, difference=False)
    made = [f"y_rolling_{s}_{w}d" for w in WINDOWS for s in STATISTICS]
    return rounded(rows.select("series_id", iso("day").alias("day"), *made), made, 6)


@query("rolling_full", rolling_sql(True))
def rolling_full(spark: SparkSession, sf: str) -> DataFrame:
    return rolling(spark, sf, True)


@query("rolling_partial", rolling_sql(False))
def rolling_partial(spark: SparkSession, sf: str) -> DataFrame:
    return rolling(spark, sf, False)


@query("diff1", f"WITH {FULL} SELECT series_id, {DAY}, round(y - lag(y) OVER w, 4) + 0.0 AS y_diff_1d FROM full_panel {W}")
def diff1(spark: SparkSession, sf: str) -> DataFrame:
    rows = window_features(full_panel(spark, sf), ["y"], ["series_id"], lags=[], windows=[])
    return rows.select("series_id", iso("day").alias("day"), r("y_diff_1d").alias("y_diff_1d"))


@query(
    "dedupe_first",
    """WITH both_tables AS (
      SELECT l_orderkey AS key, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS amount, 1 AS source_rank FROM lineitem
      UNION ALL SELECT o_orderkey, CAST(o_orderdate AS DATE), o_totalprice, 2 FROM orders),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source_rank, day, amount) AS rn FROM both_tables)
    SELECT key, strftime(day, '%Y-%m-%d') AS day, amount, source_rank FROM ranked WHERE rn = 1""",
)
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.to_date("l_shipdate").alias("day"), F.col("l_extendedprice").alias("amount")
    )
    heads = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("key"), F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("amount")
    )
    return first_per_key(ranked_stack(items, heads), ["key"], ["source_rank", "day"]).withColumn("day", iso("day"))


@query(
    "tail_n",
    f"""WITH {PANEL}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY day DESC) AS rn FROM panel)
    SELECT series_id, {DAY}, y FROM ranked WHERE rn <= 44""",
)
def tail_n(spark: SparkSession, sf: str) -> DataFrame:
    return last_rows(panel(spark, sf), 44, ["series_id"]).select("series_id", iso("day").alias("day"), "y")


@query(
    "carry_forward",
    f"""WITH {PANEL}, held AS (
      SELECT series_id, max(day) AS last_day, arg_max(y, day) AS y, arg_max(n, day) AS n FROM panel GROUP BY 1)
    SELECT series_id, step, strftime(last_day + step, '%Y-%m-%d') AS day, y, n
    FROM held, (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS step)""",
)
def carry_last(spark: SparkSession, sf: str) -> DataFrame:
    return carry_forward(panel(spark, sf), ["y", "n"], ["series_id"], 7).withColumn("day", iso("day"))


@query(
    "future_calendar",
    f"""WITH {CUSTOMER_SPANS} SELECT series_id, step, strftime(last_day + step, '%Y-%m-%d') AS day
    FROM spans, (SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS step)""",
)
def future_calendar(spark: SparkSession, sf: str) -> DataFrame:
    return future_days(customer_spans(spark, sf), ["series_id"], 7, "last_day").select(
        "series_id", "step", iso("last_day").alias("day")
    )


@query(
    "argmax_candidate",
    """WITH scores AS (
      SELECT l_suppkey, CAST(l_linenumber AS INTEGER) AS candidate, round(avg(l_discount), 6) AS score
      FROM lineitem GROUP BY 1, 2),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY score DESC, candidate) AS rn FROM scores)
    SELECT l_suppkey, candidate, score FROM ranked WHERE rn = 1""",
)
def argmax_candidate(spark: SparkSession, sf: str) -> DataFrame:
    scores = (
        table(spark, sf, "lineitem")
        .groupBy("l_suppkey", F.col("l_linenumber").alias("candidate"))
        .agg(F.round(F.avg("l_discount"), 6).alias("score"))
    )
    return best_candidate(scores, ["l_suppkey"], "candidate", "score")


SEASON = """CASE WHEN month(o_orderdate) IN (3, 4) THEN 'Spring' WHEN month(o_orderdate) IN (5, 6) THEN 'Summer'
    WHEN month(o_orderdate) IN (7, 8, 9) THEN 'Monsoon' ELSE 'Winter' END"""


@query(
    "calendar_parts",
    """SELECT o_orderkey, CAST(isodow(o_orderdate) - 1 AS INTEGER) AS day_of_week, CAST(month(o_orderdate) AS INTEGER) AS month,
    CAST(dayofyear(o_orderdate) AS INTEGER) AS day_of_year, CAST(week(o_orderdate) AS INTEGER) AS week_of_year FROM orders""",
)
def calendar(spark: SparkSession, sf: str) -> DataFrame:
    parts = calendar_parts(F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", *[e.alias(n) for n, e in parts.items()])


@query("season", f"SELECT o_orderkey, {SEASON} AS season FROM orders")
def season_of_order(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", season(F.month("o_orderdate")).alias("season"))


@query(
    "season_onehot",
    f"WITH s AS (SELECT o_orderkey, {SEASON} AS season FROM orders) SELECT o_orderkey, "
    + ", ".join(f"""CASE WHEN season = '{n}' THEN 1 ELSE 0 END AS "season_{n}" """ for n in SEASON_FLAGS)
    + " FROM s",
)
def season_onehot(spark: SparkSession, sf: str) -> DataFrame:
    flags = one_hot(season(F.month("o_orderdate")), SEASON_FLAGS, "season")
    return table(spark, sf, "orders").select("o_orderkey", *[e.alias(n) for n, e in flags.items()])


@query(
    "cyclic",
    """SELECT o_orderkey, round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin,
    round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos,
    round(sin(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS day_of_week_sin,
    round(cos(2 * pi() * (isodow(o_orderdate) - 1) / 7), 6) + 0.0 AS day_of_week_cos FROM orders""",
)
def cyclic_parts(spark: SparkSession, sf: str) -> DataFrame:
    day = F.col("o_orderdate")
    parts = {**cyclic(F.month(day), 12, "month"), **cyclic(F.weekday(day), 7, "day_of_week")}
    return table(spark, sf, "orders").select("o_orderkey", *[r(e, 6).alias(n) for n, e in parts.items()])


GAMMA = "(17.27 * l_quantity / (237.7 + l_quantity) + ln(least(greatest(l_discount * 1000, 1), 100) / 100))"


@query(
    "dew_point",
    f"SELECT l_orderkey, l_linenumber, round(237.7 * {GAMMA} / (17.27 - {GAMMA}), 6) + 0.0 AS dew_point FROM lineitem",
)
def dew_point_of_item(spark: SparkSession, sf: str) -> DataFrame:
    value = dew_point(F.col("l_quantity"), F.col("l_discount") * 1000)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", r(value, 6).alias("dew_point"))


@query(
    "destination_point",
    """WITH c AS (SELECT c_custkey, c_acctbal / 150 AS lat, c_nationkey * 7.0 AS lon, c_nationkey * 15.0 AS bearing,
      abs(c_acctbal) / 10 / 6371.0 AS d FROM customer),
    e AS (SELECT *, degrees(asin(sin(radians(lat)) * cos(d) + cos(radians(lat)) * sin(d) * cos(radians(bearing)))) AS latitude FROM c)
    SELECT c_custkey, round(latitude, 6) + 0.0 AS latitude, round(degrees(radians(lon) + atan2(sin(radians(bearing)) * sin(d) * cos(radians(lat)),
      cos(d) - sin(radians(lat)) * sin(radians(latitude)))), 6) + 0.0 AS longitude FROM e""",
)
def destination_of_customer(spark: SparkSession, sf: str) -> DataFrame:
    nation = F.col("c_nationkey").cast("double")
    lat, lon = destination_point(F.col("c_acctbal") / 150, nation * 7, F.abs("c_acctbal") / 10, nation * 15)
    return table(spark, sf, "customer").select("c_custkey", r(lat, 6).alias("latitude"), r(lon, 6).alias("longitude"))


@query(
    "interactions",
    f"""WITH {MEASURES} SELECT series_id, {DAY}, round(temperature * humidity, 8) AS temp_x_humidity,
    round(wind * cloud, 8) AS wind_x_cloud FROM measures""",
)
def interactions_of_day(spark: SparkSession, sf: str) -> DataFrame:
    pairs = {"temp_x_humidity": ("temperature", "humidity"), "wind_x_cloud": ("wind", "cloud")}
    rows = measures(spark, sf).withColumns(interactions(pairs))
    return rounded(rows.select("series_id", iso("day").alias("day"), *pairs), list(pairs), 8)


@query(
    "poly_degree2",
    f"""WITH {MEASURES}, gaps AS (
      SELECT series_id, day, temperature, CASE WHEN humidity >= 30 THEN wind END AS wind FROM measures),
    filled AS (
      SELECT series_id, day, temperature, coalesce(wind, round(avg(wind) OVER (PARTITION BY series_id), 4)) AS wind FROM gaps)
    SELECT series_id, {DAY}, round(temperature, 8) AS temperature, round(wind, 8) AS wind,
      round(temperature * temperature, 8) AS temperature_x_temperature,
      round(temperature * wind, 8) AS temperature_x_wind, round(wind * wind, 8) AS wind_x_wind FROM filled""",
)
def poly_degree2(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_measures(spark, sf).withColumn("wind", F.when(F.col("humidity") >= 30, F.col("wind")))
    rows = fill_mean(rows.select("series_id", "day", "temperature", "wind"), ["wind"], ["series_id"])
    rows = rounded(rows, ["wind"])
    terms = polynomial(["temperature", "wind"])
    return rows.select("series_id", iso("day").alias("day"), *[r(e, 8).alias(n) for n, e in terms.items()])


@query(
    "time_parse_format",
    f"""WITH {OBS} SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M') AS text,
    strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M:%S.%f') AS parsed, strftime(ts, '%Y-%m-%d') AS day FROM obs""",
)
def time_parse_format(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).withColumn("text", iso_minutes(F.col("ts")))
    parsed = parse_local(F.col("text"))
    return rows.select("event_id", "text", iso_ts(parsed).alias("parsed"), iso(F.to_date(parsed)).alias("day"))


@query(
    "label_describe",
    "SELECT l_orderkey, l_linenumber, CASE "
    + " ".join(f"WHEN l_linenumber + 1 = {k} THEN '{n}'" for k, n in CLASS_NAMES.items())
    + " WHEN l_tax > 0.07 THEN 'Unknown' ELSE 'Weather Type ' || CAST(l_linenumber + 1 AS VARCHAR) END AS condition FROM lineitem",
)
def label_describe(spark: SparkSession, sf: str) -> DataFrame:
    number = F.col("l_linenumber") + 1
    label = F.when((number <= 6) | (F.col("l_tax") <= 0.07), number)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", describe_label(label).alias("condition"))


@query(
    "minmax_from_mean",
    f"""WITH {PANEL}, {OFFSETS} SELECT series_id, {DAY}, round(y + 3, 4) AS high_fixed, round(y - 3, 4) + 0.0 AS low_fixed,
    round(y + up, 6) AS high_learned, round(y - down, 6) + 0.0 AS low_learned FROM panel JOIN offsets USING (series_id)""",
)
def minmax_from_mean(spark: SparkSession, sf: str) -> DataFrame:
    rows = stored_panel(spark, sf).where(F.col("y").isNotNull())
    rows = rows.join(diurnal_offsets(rows, ["series_id"], "y", "y_max", "y_min"), "series_id")
    high, low = spread_from_mean(F.col("y"))
    high_learned, low_learned = spread_from_mean(F.col("y"), F.col("up"), F.col("down"))
    return rows.select(
        "series_id",
        iso("day").alias("day"),
        r(high).alias("high_fixed"),
        r(low).alias("low_fixed"),
        r(high_learned, 6).alias("high_learned"),
        r(low_learned, 6).alias("low_learned"),
    )

"""Scans, payloads, read plans and writers on the given tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import (
    CUSTOMER_SPANS,
    HOURLY,
    OBS,
    PANEL,
    customer_spans,
    hourly,
    iso,
    iso_ts,
    obs,
    panel,
    table,
)
from panelcast.catalog.registry import query
from panelcast.operators.autoreg import seasonal_naive
from panelcast.operators.combine import ranked_stack, stack
from panelcast.operators.dedupe import first_per_key
from panelcast.functions.present import fixed_decimals
from panelcast.session import fresh_path
from panelcast.sources.chunks import is_short_period, month_chunks
from panelcast.sources.payloads import pack_days, read_payloads, to_payload, unpack_text
from panelcast.sources.tables import covered_rows, scan, select_ordered
from panelcast.sources.writers import (
    append_if_absent,
    duplicate_keys,
    nan_to_null,
    new_rows,
    without_month,
    write_csv,
)

STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f')"
DAY_TEXT = "strftime({0}, '%Y-%m-%d')"


@query(
    "scan_range",
    f"""WITH {OBS} SELECT series_id, {STAMP.format('ts')} AS ts, value FROM obs
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21'""",
)
def scan_range(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan(obs(spark, sf), ["series_id", "ts", "value"], date(2024, 1, 5), date(2024, 1, 20))
    return rows.orderBy("ts").withColumn("ts", iso_ts("ts"))


@query(
    "scan_series_range",
    f"""WITH {OBS} SELECT series_id, {STAMP.format('ts')} AS ts, value, k FROM obs
    WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-21' AND series_id = 'view'""",
)
def scan_series_range(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["series_id", "ts", "value", "k"]
    rows = scan(obs(spark, sf), columns, date(2024, 1, 5), date(2024, 1, 20), series="view")
    return rows.withColumn("ts", iso_ts("ts"))


@query(
    "scan_dynamic",
    f"""SELECT l_orderkey, l_linenumber, {DAY_TEXT.format('l_shipdate')} AS l_shipdate, l_quantity FROM lineitem
    WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1999-01-01' AND l_returnflag = 'R'""",
)
def scan_dynamic(spark: SparkSession, sf: str) -> DataFrame:
    rows = scan(
        table(spark, sf, "lineitem"),
        ["l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", "l_orderkey"],
        date(1997, 1, 1),
        date(1998, 12, 31),
        ts="l_shipdate",
        series="R",
        series_col="l_returnflag",
    )
    return rows.withColumn("l_shipdate", iso("l_shipdate"))


PAYLOAD_VARIABLES = ["temperature_2m", "relative_humidity_2m", "wind_speed_10m"]


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    return to_payload(pack_days(hourly(spark, sf), PAYLOAD_VARIABLES), PAYLOAD_VARIABLES)


@query(
    "json_unpack_hourly",
    f"""WITH {HOURLY} SELECT series_id AS region_name, {STAMP.format('ts')} AS ts, CAST(28.6448 AS DOUBLE) AS latitude,
    CAST(77.2167 AS DOUBLE) AS longitude, temperature_2m, relative_humidity_2m, wind_speed_10m FROM hourly""",
)
def json_unpack_hourly(spark: SparkSession, sf: str) -> DataFrame:
    place = {"latitude": F.lit(28.6448), "longitude": F.lit(77.2167)}
    rows = unpack_text(payloads(spark, sf), "payload", PAYLOAD_VARIABLES, ["series_id"], place)
    return rows.withColumnRenamed("series_id", "region_name").withColumn("ts", iso_ts("ts"))


@query(
    "json_invalid_dropped",
    f"""WITH {HOURLY} SELECT series_id, {STAMP.format('ts')} AS ts, temperature_2m FROM hourly
    WHERE series_id NOT IN ('click', 'error', 'signup')""",
)
def json_invalid_dropped(spark: SparkSession, sf: str) -> DataFrame:
    name, text = F.col("series_id"), F.col("payload")
    # one series is answered with an error object, one with cut-off text, one without times
    broken = (
        F.when(name == "error", F.lit('{"error": true, "reason": "limit"}'))
        .when(name == "click", F.substring("payload", 1, 20))
        .when(name == "signup", F.lit('{"hourly": {"time": []}}'))
        .otherwise(text)
    )
    landed = payloads(spark, sf).withColumn("payload", broken)
    return unpack_text(landed, "payload", ["temperature_2m"], ["series_id"]).withColumn("ts", iso_ts("ts"))


@query(
    "json_missing_cols",
    f"""WITH {HOURLY} SELECT series_id, {STAMP.format('ts')} AS ts, temperature_2m,
    CAST(NULL AS DOUBLE) AS snow_depth FROM hourly""",
)
def json_missing_cols(spark: SparkSession, sf: str) -> DataFrame:
    rows = unpack_text(payloads(spark, sf), "payload", ["temperature_2m", "snow_depth"], ["series_id"])
    return rows.withColumn("ts", iso_ts("ts"))


@query("select_ordered", "SELECT l_orderkey, l_linenumber, l_tax, l_discount FROM lineitem")
def select_in_order(spark: SparkSession, sf: str) -> DataFrame:
    wanted = ["l_orderkey", "l_linenumber", "l_tax", "l_orderkey", "absent", "l_discount", "l_tax"]
    return select_ordered(table(spark, sf, "lineitem"), wanted)


@query(
    "multi_source_union",
    f"""WITH {HOURLY} SELECT series_id, {STAMP.format('ts')} AS ts, temperature_2m, relative_humidity_2m,
    wind_speed_10m FROM hourly""",
)
def multi_source_union(spark: SparkSession, sf: str) -> DataFrame:
    base = fresh_path(spark, "payloads")
    payloads(spark, sf).select("series_id", F.col("payload").alias("value")).write.partitionBy("series_id").text(base)
    rows = read_payloads(spark, [base], PAYLOAD_VARIABLES, base)
    return rows.withColumn("ts", iso_ts("ts"))


@query(
    "union_archive_and_current",
    f"""WITH {HOURLY}, both_feeds AS (
      SELECT series_id, ts, temperature_2m, 1 AS source_rank FROM hourly WHERE ts < TIMESTAMP '2024-01-25'
      UNION ALL
      SELECT series_id, ts, temperature_2m + 100, 2 FROM hourly WHERE ts >= TIMESTAMP '2024-01-20'),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY source_rank) AS rn FROM both_feeds)
    SELECT series_id, {STAMP.format('ts')} AS ts, round(temperature_2m, 4) AS temperature_2m, source_rank
    FROM ranked WHERE rn = 1""",
)
def union_archive_and_current(spark: SparkSession, sf: str) -> DataFrame:
    rows = hourly(spark, sf).select("series_id", "ts", "temperature_2m")
    archive = rows.where(F.col("ts") < F.lit("2024-01-25").cast("timestamp_ntz"))
    current = rows.where(F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    current = current.withColumn("temperature_2m", F.col("temperature_2m") + 100)
    merged = first_per_key(ranked_stack(archive, current), ["series_id", "ts"], ["source_rank"])
    return merged.withColumns({"ts": iso_ts("ts"), "temperature_2m": F.round("temperature_2m", 4)})


@query(
    "month_chunks",
    f"""WITH {CUSTOMER_SPANS}, months AS (
      SELECT series_id, first_day, last_day,
             CAST(unnest(generate_series(date_trunc('month', first_day), CAST(last_day AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS m
      FROM spans)
    SELECT series_id, {DAY_TEXT.format('greatest(m, first_day)')} AS chunk_start,
           {DAY_TEXT.format('least(last_day(m), last_day)')} AS chunk_end, monthname(m) AS month_name
    FROM months""",
)
def chunks_by_month(spark: SparkSession, sf: str) -> DataFrame:
    rows = month_chunks(customer_spans(spark, sf), "first_day", "last_day", ["series_id"])
    return rows.withColumns({"chunk_start": iso("chunk_start"), "chunk_end": iso("chunk_end")})


@query(
    "chunk_short_period",
    f"""WITH {CUSTOMER_SPANS}
    SELECT series_id, CASE WHEN date_trunc('month', first_day) = date_trunc('month', last_day)
      OR date_diff('day', first_day, last_day) < day(last_day(first_day)) THEN 1 ELSE 0 END AS short_period
    FROM spans""",
)
def chunk_short_period(spark: SparkSession, sf: str) -> DataFrame:
    short = is_short_period(F.col("first_day"), F.col("last_day"))
    return customer_spans(spark, sf).select("series_id", short.cast("int").alias("short_period"))


@query(
    "duplicate_keys",
    """SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, count(*) AS copies
    FROM orders GROUP BY 1, 2 HAVING count(*) > 1""",
)
def keys_held_twice(spark: SparkSession, sf: str) -> DataFrame:
    rows = duplicate_keys(table(spark, sf, "orders"), ["o_orderpriority", "o_orderdate"])
    return rows.withColumn("o_orderdate", iso("o_orderdate"))


UPSERT = f"""{OBS}, target AS (SELECT series_id, ts, value FROM obs WHERE ts < TIMESTAMP '2024-01-20'),
batch AS (
  SELECT series_id, ts, value + 1000 AS value, 1 AS arrival FROM obs WHERE ts >= TIMESTAMP '2024-01-10'
  UNION ALL
  SELECT series_id, ts, value + 2000, 2 FROM obs WHERE ts >= TIMESTAMP '2024-01-15'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series_id, ts ORDER BY arrival) AS rn FROM batch),
fresh AS (
  SELECT series_id, ts, value FROM ranked
  WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM target t WHERE t.series_id = ranked.series_id AND t.ts = ranked.ts))"""


def target_and_batch(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = obs(spark, sf).select("series_id", "ts", "value")

    def since(text: str, offset: int, arrival: int) -> DataFrame:
        late = rows.where(F.col("ts") >= F.lit(text).cast("timestamp_ntz"))
        return late.withColumns({"value": F.col("value") + offset, "arrival": F.lit(arrival)})

    target = rows.where(F.col("ts") < F.lit("2024-01-20").cast("timestamp_ntz"))
    return target, stack(since("2024-01-10", 1000, 1), since("2024-01-15", 2000, 2))


@query(
    "upsert_ignore",
    f"""WITH {UPSERT}, merged AS (SELECT * FROM target UNION ALL SELECT * FROM fresh)
    SELECT series_id, {STAMP.format('ts')} AS ts, round(value, 2) AS value FROM merged""",
)
def upsert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    target, batch = target_and_batch(spark, sf)
    path, keys = fresh_path(spark, "observations"), ["series_id", "ts"]
    append_if_absent(spark, target, path, keys, ["value"])
    for _ in range(2):  # the second pass of the same batch must add nothing
        append_if_absent(spark, batch, path, keys, ["arrival"], drop=["arrival"])
    return spark.read.parquet(path).select("series_id", iso_ts("ts").alias("ts"), F.round("value", 2).alias("value"))


@query(
    "anti_join_new_keys",
    f"""WITH {UPSERT} SELECT series_id, {STAMP.format('ts')} AS ts, arrival FROM batch b
    WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.series_id = b.series_id AND t.ts = b.ts)""",
)
def anti_join_new_keys(spark: SparkSession, sf: str) -> DataFrame:
    target, batch = target_and_batch(spark, sf)
    return new_rows(batch, target, ["series_id", "ts"]).select("series_id", iso_ts("ts").alias("ts"), "arrival")


@query(
    "nan_to_null",
    f"WITH {OBS} SELECT event_id, CASE WHEN k >= 10 THEN value END AS value FROM obs",
)
def missing_to_null(spark: SparkSession, sf: str) -> DataFrame:
    rows = obs(spark, sf).withColumn("value", F.when(F.col("k") < 10, F.lit(float("nan"))).otherwise(F.col("value")))
    return nan_to_null(rows.select("event_id", "value"))


@query(
    "delete_month",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_totalprice FROM orders
    WHERE strftime(o_orderdate, '%Y-%m-%d') NOT LIKE '1998-05-%'""",
)
def delete_month(spark: SparkSession, sf: str) -> DataFrame:
    left = without_month(table(spark, sf, "orders"), "o_orderdate", "1998-05-%")
    return left.select("o_orderkey", iso("o_orderdate").alias("o_orderdate"), "o_totalprice")


@query(
    "csv_roundtrip",
    f"""WITH {PANEL} SELECT series_id, {DAY_TEXT.format('day')} AS day, y, n FROM panel""",
)
def csv_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    rows = panel(spark, sf).select("series_id", iso("day").alias("day"), "y", "n")
    path = write_csv(rows, fresh_path(spark, "csv"), "historical", 2001)
    return spark.read.schema("series_id string, day string, y double, n int").option("header", True).csv(path)


@query(
    "series_pack",
    f"""WITH {HOURLY} SELECT series_id, {DAY_TEXT.format('ts')} AS day, CAST(count(*) AS INTEGER) AS entries,
    string_agg(strftime(ts, '%H'), ',' ORDER BY ts) AS hours, arg_min(temperature_2m, ts) AS first_value,
    arg_max(temperature_2m, ts) AS last_value FROM hourly GROUP BY 1, 2""",
)
def series_pack(spark: SparkSession, sf: str) -> DataFrame:
    packed = pack_days(hourly(spark, sf), ["temperature_2m", "cloud_cover"])
    values = F.col("entries")["temperature_2m"]
    return packed.select(
        "series_id",
        iso("day").alias("day"),
        F.size("entries").alias("entries"),
        F.array_join(F.transform("entries", lambda e: F.date_format(e["ts"], "HH")), ",").alias("hours"),
        F.element_at(values, 1).alias("first_value"),
        F.element_at(values, -1).alias("last_value"),
    )


@query(
    "coverage_gate",
    f"""WITH {CUSTOMER_SPANS} SELECT o_custkey, o_orderkey FROM orders JOIN spans ON series_id = o_custkey
    WHERE first_day <= DATE '1996-01-01' AND last_day >= DATE '2000-12-31'""",
)
def coverage_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    kept = covered_rows(rows, ["o_custkey"], "o_orderdate", date(1996, 1, 1), date(2000, 12, 31))
    return kept.select("o_custkey", "o_orderkey")


@query(
    "format_forecast",
    f"""WITH {PANEL}, naive AS (
      SELECT series_id, day, y, coalesce(lag(y, 7) OVER w, lag(y, 1) OVER w) AS f FROM panel
      WINDOW w AS (PARTITION BY series_id ORDER BY day))
    SELECT series_id, {DAY_TEXT.format('day')} AS day,
      coalesce(CAST(CAST(CAST(f AS DECIMAL(18, 4)) AS DECIMAL(18, 2)) AS VARCHAR), 'N/A') AS avg_text,
      coalesce(CAST(CAST(CAST(f + 3 AS DECIMAL(18, 4)) AS DECIMAL(18, 1)) AS VARCHAR), 'N/A') AS max_text
    FROM naive""",
)
def format_forecast(spark: SparkSession, sf: str) -> DataFrame:
    rows = seasonal_naive(panel(spark, sf), ["series_id"], "y")
    return rows.select(
        "series_id",
        iso("day").alias("day"),
        fixed_decimals(F.col("naive"), 2).alias("avg_text"),
        fixed_decimals(F.round(F.col("naive") + 3, 4), 1).alias("max_text"),
    )



from __future__ import annotations

import glob
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from panelcast.functions.dates import iso_minutes
from panelcast.schema import ADVANCED_VARIABLES, BASIC_VARIABLES, daily_map, hourly_schema
from panelcast.session import fresh_path, shared_folder
from panelcast.sources.chunks import is_short_period, month_chunks
from panelcast.sources.payloads import pack_days, read_payloads, to_payload, unpack_text
from panelcast.sources.tables import in_range, like_prefix, prefix_bounds, scan
from panelcast.sources.writers import (
    append_if_absent,
    duplicate_keys,
    insert_if_absent,
    nan_to_null,
    delete_month,
    write_csv,
    write_partitioned,
)
from panelcast.operators.dedupe import first_per_key
from panelcast.streaming.flows import arriving, as_instant, daily_windows, start_daily, start_ingest


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_schema_has_all_variables():
    fields = hourly_schema(BASIC_VARIABLES + ADVANCED_VARIABLES).names
    assert len(fields) == 2 + 7 + 27
    chosen = daily_map(BASIC_VARIABLES)
    assert chosen["precipitation"] == ["sum"]
    assert chosen["wind_direction_10m"] == ["first"]
    assert chosen["weather_code"] == ["last"]


def test_closed_range_admits_next_midnight(hourly):
    rows = hourly.where(F.col("series_id") == "b")
    span = (date(2024, 2, 28), date(2024, 2, 29))
    assert rows.where(in_range(F.col("ts"), *span)).count() == 48
    assert rows.where(in_range(F.col("ts"), *span, inclusive_end=True)).count() == 49


@pytest.mark.parametrize(
    ("prefix", "low", "high"),
    [
        ("2024-02-%", date(2024, 2, 1), date(2024, 2, 29)),
        ("2024-12-", date(2024, 12, 1), date(2024, 12, 31)),
        ("2024-02-24%", date(2024, 2, 24), date(2024, 2, 24)),
        ("2024", date(2024, 1, 1), date(2024, 12, 31)),
    ],
)
def test_prefix_bounds(prefix, low, high):
    assert prefix_bounds(prefix) == (low, high)


def test_prefix_rejects_other_text():
    with pytest.raises(ValueError):
        prefix_bounds("May 2024")


def test_range_and_columns_reach_the_file_scan(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    text = plan(scan(rows, ["ts", "value"], date(2024, 1, 3), date(2024, 1, 4)))
    assert "GreaterThanOrEqual(ts" in text and "LessThan(ts" in text
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in text
    assert "GreaterThanOrEqual(ts" in plan(rows.where(like_prefix(F.col("ts"), "2024-01-%")))


PAYLOADS = [
    ("ok", '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "t": [11.0, null], "w": [1, 2]}}'),
    ("missing", '{"hourly": {"time": ["2024-01-01T00:00"], "t": [3.5]}}'),
    ("short", '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "t": [1.0]}}'),
    ("no hourly", '{"error": true}'),
    ("empty", '{"hourly": {"time": [], "t": []}}'),
    ("no json", "<html>"),
    ("null", None),
]


def test_payload_cases(spark):
    df = spark.createDataFrame(PAYLOADS, "region string, payload string")
    rows = unpack_text(df, "payload", ["t", "w"], ["region"], {"lat": F.lit(1.5)})
    got = {(r.region, r.ts.hour): (r.lat, r.t, r.w) for r in rows.collect()}
    assert got == {
        ("ok", 0): (1.5, 11.0, 1.0),
        ("ok", 1): (1.5, None, 2.0),
        ("missing", 0): (1.5, 3.5, None),
        ("short", 0): (1.5, 1.0, None),
        ("short", 1): (1.5, None, None),
    }


def test_payload_files_come_back(spark, hourly):
    base = fresh_path(spark, "test-payloads")
    clean = nan_to_null(hourly)
    landed = to_payload(pack_days(clean, ["temperature"]), ["temperature"])
    landed.select("series_id", F.col("payload").alias("value")).write.partitionBy("series_id").text(base)
    back = read_payloads(spark, [f"{base}/series_id={k}" for k in "abc"], ["temperature"], base)
    want = clean.select("series_id", iso_minutes(F.col("ts")).alias("ts"), "temperature")
    got = back.select("series_id", iso_minutes(F.col("ts")).alias("ts"), "temperature")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_month_chunks_clamp(spark):
    df = spark.createDataFrame([(1, date(2023, 12, 15), date(2024, 2, 10))], "id int, a date, b date")
    rows = month_chunks(df, "a", "b", ["id"]).orderBy("chunk_start").collect()
    assert [(r.chunk_start, r.chunk_end, r.month_name) for r in rows] == [
        (date(2023, 12, 15), date(2023, 12, 31), "December"),
        (date(2024, 1, 1), date(2024, 1, 31), "January"),
        (date(2024, 2, 1), date(2024, 2, 10), "February"),
    ]
    assert month_chunks(df, "a", "b", ["id"], clamp_start=False).agg(F.min("chunk_start")).first()[0] == date(2023, 12, 1)


def test_short_period(spark):
    rows = [
        (date(2024, 1, 1), date(2024, 1, 31), True),
        (date(2024, 1, 20), date(2024, 2, 10), True),
        (date(2024, 1, 1), date(2024, 2, 1), False),
        (date(2024, 2, 10), date(2024, 3, 10), False),
    ]
    df = spark.createDataFrame(rows, "a date, b date, want boolean")
    assert df.where(is_short_period(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_first_per_key_on_a_hot_key(spark):
    hot = spark.range(200_000).select(F.lit("hot").alias("k"), F.col("id").alias("rank"), (F.col("id") * 2).alias("v"))
    rest = spark.range(10).select(F.col("id").cast("string").alias("k"), F.lit(5).cast("long").alias("rank"), F.lit(1).cast("long").alias("v"))
    first = first_per_key(hot.union(rest), ["k"], ["rank"])
    assert "Window" not in plan(first)
    assert {r.k: (r["rank"], r.v) for r in first.collect()}["hot"] == (0, 0)
    assert first.count() == 11


def test_insert_if_absent_is_idempotent(spark, hourly):
    path = fresh_path(spark, "test-upsert")
    keys = ["series_id", "ts"]
    early = hourly.where(F.col("ts") < F.lit("2021-01-20").cast("timestamp_ntz"))
    append_if_absent(spark, early, path, keys, ["temperature"])
    before = spark.read.parquet(path).count()
    later = hourly.withColumn("temperature", F.lit(-1.0))
    for _ in range(2):
        append_if_absent(spark, later, path, keys, ["temperature"])
    table = spark.read.parquet(path)
    assert before == early.count() and table.count() == hourly.count()
    assert duplicate_keys(table, keys).count() == 0
    assert table.where(F.col("temperature") == -1.0).count() == hourly.count() - before


def test_only_touched_months_are_read(spark, hourly):
    path = fresh_path(spark, "test-pruned")
    write_partitioned(hourly, path)
    batch = hourly.where(F.date_format("ts", "yyyy-MM") == "2021-01")
    text = plan(insert_if_absent(batch, spark.read.parquet(path), ["series_id", "ts"], ["temperature"], "ts"))
    assert "PartitionFilters: [isnotnull(year" in text


def test_streamed_days_do_not_follow_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        df = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-01 03:15:00.25' AS ts").select(as_instant(F.col("ts")).alias("at"))
        assert df.select(F.unix_micros("at")).first()[0] == 1704078900250000
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_empty_batch_adds_nothing(spark, hourly):
    path = fresh_path(spark, "test-empty")
    keys = ["series_id", "ts"]
    append_if_absent(spark, hourly, path, keys, ["temperature"])
    append_if_absent(spark, hourly.limit(0), path, keys, ["temperature"])
    assert spark.read.parquet(path).count() == hourly.count()


def month_files(path):
    place = path.removeprefix("file:")
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{place}/year=*/month=*/*.parquet")}


def test_a_deleted_month_leaves_the_files_of_all_others(spark, hourly):
    path, keys = fresh_path(spark, "test-delete"), ["series_id", "ts"]
    write_partitioned(hourly, path)
    before, month = month_files(path), F.date_format("ts", "yyyy-MM")
    delete_month(spark, path, "ts", "2021-01-%")
    after = month_files(path)
    assert after == {f: t for f, t in before.items() if "/year=2021/month=1/" not in f} and len(after) < len(before)
    left = spark.read.parquet(path)
    assert left.where(month == "2021-01").count() == 0
    assert left.count() == hourly.where(month != "2021-01").count()
    append_if_absent(spark, hourly, path, keys, ["temperature"])
    assert spark.read.parquet(path).count() == hourly.count()
    assert {f for f in before if "/year=2021/month=1/" not in f} <= set(month_files(path))


def test_a_part_of_a_month_can_be_deleted(spark, hourly):
    path = fresh_path(spark, "test-delete-days")
    write_partitioned(hourly, path)
    others = {f: t for f, t in month_files(path).items() if "/year=2024/month=2/" not in f}
    delete_month(spark, path, "ts", "2024-02-15%")
    delete_month(spark, path, "ts", "1999-%")
    got = spark.read.parquet(path)
    assert got.where(F.date_format("ts", "yyyy-MM-dd").like("2024-02-15%")).count() == 0
    assert got.count() == hourly.where(~F.date_format("ts", "yyyy-MM-dd").like("2024-02-15%")).count()
    assert others.items() <= month_files(path).items()


def test_a_table_refuses_other_types(spark):
    schema, path, keys = hourly_schema(["temperature_2m"]), fresh_path(spark, "test-typed"), ["series_id", "ts"]
    good = spark.createDataFrame([("a", datetime(2024, 1, 1), 1.0)], schema)
    append_if_absent(spark, good, path, keys, ["temperature_2m"], schema=schema)
    for bad in (good.withColumn("temperature_2m", F.lit("1")), good.drop("temperature_2m"), good.withColumn("more", F.lit(1))):
        with pytest.raises(ValueError):
            append_if_absent(spark, bad, path, keys, ["series_id"], schema=schema)
    assert spark.read.parquet(path).count() == 1


def test_rows_without_a_key_are_rejected(spark, hourly):
    path, keys = fresh_path(spark, "test-null-key"), ["series_id", "ts"]
    some = hourly.limit(5).withColumn("series_id", F.lit(None).cast("string")).unionByName(hourly.limit(5))
    for _ in range(2):
        append_if_absent(spark, some, path, keys, ["temperature"])
    assert spark.read.parquet(path).count() == 5


def test_csv_path_names_the_year(spark, hourly):
    path = write_csv(hourly.limit(3), fresh_path(spark, "test-csv"), "historical", date(2025, 1, 1))
    assert path.endswith("historical_2025_results.csv")
    assert spark.read.option("header", True).csv(path).count() == 3


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        assert shared_folder(spark) == named.rstrip("/")
    else:
        assert shared_folder(spark) == spark.sparkContext.getCheckpointDir().rstrip("/")


def test_stream_of_many_files_equals_batch(spark, hourly):
    landing, table = fresh_path(spark, "test-landing"), fresh_path(spark, "test-ingested")
    rows = nan_to_null(hourly).withColumn("arrival", F.lit(1))
    again = rows.withColumns({"temperature": F.lit(-5.0), "arrival": F.lit(2)})
    rows.unionByName(again).repartition(6).write.parquet(landing)
    keys, checkpoint = ["series_id", "ts"], fresh_path(spark, "test-checkpoint")
    for _ in range(2):
        stream = arriving(spark, landing, rows.schema, files_per_batch=2)
        start_ingest(stream, table, checkpoint, keys, ["arrival"]).awaitTermination()
    got = spark.read.parquet(table)
    assert got.count() == hourly.count() and duplicate_keys(got, keys).count() == 0


def test_streamed_days_equal_batch_days(spark, hourly):
    landing, out = fresh_path(spark, "test-days-in"), fresh_path(spark, "test-days-out")
    b = hourly.where(F.col("series_id") == "b")
    b.coalesce(1).write.parquet(landing)
    windows = daily_windows(arriving(spark, landing, b.schema), "temperature", ["series_id"], "1 hour")
    start_daily(windows, out, fresh_path(spark, "test-days-checkpoint")).awaitTermination()
    got = {r.day: r.temperature_mean for r in spark.read.parquet(out).collect()}
    want = {r.day: r.m for r in b.groupBy(F.to_date("ts").alias("day")).agg(F.avg("temperature").alias("m")).collect()}
    last = max(want)
    assert got == {d: m for d, m in want.items() if d != last}
    assert datetime(2024, 2, 29).date() in got

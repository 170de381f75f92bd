"""Streams over the event files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.catalog.inputs import OBS, iso, iso_ts, r, table
from panelcast.catalog.registry import query
from panelcast.session import fresh_path
from panelcast.streaming.flows import arriving, daily_windows, start_daily, start_ingest


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = table(spark, sf, "events").schema
    stream = arriving(spark, f"{sf}/events.parquet", schema)
    return stream.select("event_id", F.col("event_type").alias("series_id"), "ts", "value")


@query(
    "stream_ingest",
    f"""WITH {OBS} SELECT series_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, arg_min(value, event_id) AS value
    FROM obs GROUP BY series_id, obs.ts""",
)
def stream_ingest(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "ingested")
    for run in range(2):  # the range is fetched again; the second pass adds nothing
        checkpoint = fresh_path(spark, f"ingest-{run}")
        start_ingest(event_stream(spark, sf), path, checkpoint, ["series_id", "ts"], ["event_id"]).awaitTermination()
    return spark.read.parquet(path).select("series_id", iso_ts("ts").alias("ts"), "value")


@query(
    "stream_daily_agg",
    f"""WITH {OBS}, days AS (
      SELECT series_id, CAST(ts AS DATE) AS day, round(avg(value), 6) AS value_mean, min(value) AS value_min,
        max(value) AS value_max, count(value) AS n FROM obs GROUP BY 1, 2)
    SELECT series_id, strftime(day, '%Y-%m-%d') AS day, value_mean, value_min, value_max, n FROM days
    WHERE CAST(day + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 2 HOUR FROM obs)""",
)
def stream_daily_agg(spark: SparkSession, sf: str) -> DataFrame:
    path = fresh_path(spark, "closed-days")
    windows = daily_windows(event_stream(spark, sf), "value", ["series_id"], "2 hours")
    start_daily(windows, path, fresh_path(spark, "closed-days-checkpoint")).awaitTermination()
    return spark.read.parquet(path).withColumns({"day": iso("day"), "value_mean": r("value_mean", 6)})

"""Structured Streaming: first-write-wins ingest and daily windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from panelcast.sources.writers import append_if_absent


def arriving(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files as a stream, in the order they arrive; `path` is a folder or one file."""
    reader = spark.readStream.schema(schema)
    # the file source takes one file only as a pattern, which also finds a folder of that name
    pattern = f"{path[:-1]}[{path[-1]}]"
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(pattern)


def start_ingest(
    stream: DataFrame,
    table: str,
    checkpoint: str,
    keys: list[str],
    order: list[str],
    ts: str = "ts",
    drop: list[str] | None = None,
) -> StreamingQuery:
    """Each micro-batch adds the keys the table lacks; the first write of a key wins.

    A replayed batch finds its keys present and adds nothing, so a restart after
    a failure neither loses nor repeats rows.
    """

    def add(batch: DataFrame, _: int) -> None:
        append_if_absent(batch.sparkSession, batch, table, keys, order, ts, drop)

    return (
        stream.writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def as_instant(ts: Column) -> Column:
    """Local time without zone as an instant of UTC, whatever the session's zone.

    Event-time columns must be instants, and windows of a day begin at midnight UTC.
    """
    parts = [F.date_part(F.lit(p), ts) for p in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND")]
    return F.make_timestamp(*parts, F.lit("UTC"))


def daily_windows(stream: DataFrame, value: str, keys: list[str], delay: str, ts: str = "ts") -> DataFrame:
    """Mean, minimum, maximum and count per series and day, final once the watermark passes the day."""
    timed = stream.withColumn("_at", as_instant(F.col(ts))).withWatermark("_at", delay)
    grouped = timed.groupBy(*keys, F.window("_at", "1 day").alias("_day")).agg(
        F.min(F.to_date(ts)).alias("day"),
        F.avg(value).alias(f"{value}_mean"),
        F.min(value).alias(f"{value}_min"),
        F.max(value).alias(f"{value}_max"),
        F.count(value).alias("n"),
    )
    return grouped.drop("_day")


def start_daily(windows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append closed days to a Parquet table."""
    return (
        windows.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )

"""Landed JSON payloads of parallel hourly arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelcast.functions.dates import iso_minutes, parse_local
from panelcast.schema import SERIES, TS, payload_schema, unique_names


def unpack(
    df: DataFrame,
    hourly: Column,
    variables: list[str],
    keep: list[str],
    constants: dict[str, Column] | None = None,
) -> DataFrame:
    """One row per array position.

    A variable the payload lacks arrives as a NULL array and gives a typed NULL
    column; a payload without readable times gives no rows.
    """
    names = unique_names(variables)
    times = hourly["time"]
    rows = F.transform(
        times,
        lambda t, i: F.struct(
            t.alias("time"),
            *[F.get(hourly[v], i).cast("double").alias(v) for v in names],
        ),
    )
    flat = df.select(*keep, F.inline(F.coalesce(rows, F.expr("array()").cast(rows_type(names)))))
    flat = flat.withColumn(TS, parse_local(F.col("time")))
    return flat.select(*keep, TS, *[v.alias(k) for k, v in (constants or {}).items()], *names)


def rows_type(names: list[str]) -> str:
    return "array<struct<time:string," + ",".join(f"`{n}`:double" for n in names) + ">>"


def unpack_text(
    df: DataFrame, payload: str, variables: list[str], keep: list[str], constants: dict[str, Column] | None = None
) -> DataFrame:
    """Payload held as text; what is not JSON, has no `hourly` or no times is dropped."""
    parsed = df.withColumn("_parsed", F.from_json(F.col(payload), payload_schema(variables)))
    return unpack(
        parsed.where(F.size(F.col("_parsed.hourly.time")) > 0), F.col("_parsed.hourly"), variables, keep, constants
    )


def read_payloads(spark: SparkSession, paths: list[str], variables: list[str], base: str | None = None) -> DataFrame:
    """All locations in one read: Spark spreads the files, no request loop is needed."""
    reader = spark.read.schema(payload_schema(variables))
    if base:
        reader = reader.option("basePath", base)
    landed = reader.json(paths)
    keep = [c for c in landed.columns if c != "hourly"]
    return unpack(landed.where(F.size(F.col("hourly.time")) > 0), F.col("hourly"), variables, keep)


def pack_days(df: DataFrame, variables: list[str], series: str = SERIES, ts: str = TS) -> DataFrame:
    """Rows to ordered entries per series and day.

    The hourly table has one row per series and hour, so an array holds at most
    24 entries however large the table is.
    """
    entry = F.struct(F.col(ts).alias("ts"), *[F.col(v).alias(v) for v in variables])
    return df.groupBy(series, F.to_date(ts).alias("day")).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def to_payload(packed: DataFrame, variables: list[str]) -> DataFrame:
    """Packed days back to the landed JSON form."""
    arrays = [F.transform("entries", lambda e: iso_minutes(e["ts"])).alias("time")]
    arrays += [F.col("entries")[v].alias(v) for v in variables]
    text = F.to_json(F.struct(F.struct(*arrays).alias("hourly")))
    return packed.select(*[c for c in packed.columns if c != "entries"], text.alias("payload"))

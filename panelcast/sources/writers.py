"""Writers: insert-if-absent, month deletes, CSV, missing values."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from panelcast.operators.dedupe import first_per_key
from panelcast.session import discard, remove_folder, write_table
from panelcast.sources.bundles import absent
from panelcast.sources.tables import in_range, like_prefix


def nan_to_null(df: DataFrame) -> DataFrame:
    """NULL is the only missing value: NaN of float columns becomes NULL."""
    out = [
        F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
        else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*out)


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """The unique-key check as data: keys held by more than one row."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)


def new_rows(batch: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """Batch rows whose key the target does not hold."""
    return batch.join(target.select(*keys), keys, "left_anti")


def insert_if_absent(
    batch: DataFrame, target: DataFrame, keys: list[str], order: list[str], ts: str | None = None
) -> DataFrame:
    """Rows to append: the first of each key in the batch (by `order`) that the target lacks.

    With `ts` the target is read only for the days the batch touches, and of a
    table with `year` and `month` folders only those months.
    """
    return absent_rows(first_per_key(batch, keys, order), target, keys, ts)


def absent_rows(rows: DataFrame, target: DataFrame, keys: list[str], ts: str | None = None) -> DataFrame:
    """The rows whose key the target lacks; with `ts`, of the target only the days that the rows touch are read."""
    if ts is not None:
        span = rows.agg(F.min(F.to_date(ts)), F.max(F.to_date(ts))).first()
        if span[0] is None:
            return rows
        target = target.where(in_range(F.col(ts), span[0], span[1]))
        if {"year", "month"} <= set(target.columns):
            target = target.where(in_months(span[0], span[1]))
    return new_rows(rows, target, keys)


def in_months(start: date, end: date) -> Column:
    """The folders of a table laid out by year and month that a day range touches."""
    number = F.col("year") * 12 + F.col("month")
    return number.between(start.year * 12 + start.month, end.year * 12 + end.month)


def check_schema(df: DataFrame, schema: T.StructType) -> None:
    """Raises unless the rows have the table's columns with its types; see `hourly_schema`. The order may differ."""
    got = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    want = {f.name: f.dataType.simpleString() for f in schema.fields}
    wrong = sorted(n for n in {*got, *want} if got.get(n) != want.get(n))
    if wrong:
        raise ValueError("; ".join(f"{n}: {got.get(n, 'missing')} instead of {want.get(n, 'no such column')}" for n in wrong))


def append_if_absent(
    spark: SparkSession,
    batch: DataFrame,
    path: str,
    keys: list[str],
    order: list[str],
    ts: str = "ts",
    drop: list[str] | None = None,
    schema: T.StructType | None = None,
) -> None:
    """First write wins on a Parquet table with `year` and `month` folders; one writer at a time.

    Keys are NOT NULL: rows that lack one are rejected, as no later run could recognise them. With a schema, rows of other
    columns or types are refused as a whole. The first row of each key of the batch is stored once; its
    span, the search for known keys and the write read that.
    A table that exists but cannot be read is an error, never taken for an absent one.
    """
    if schema is not None:
        check_schema(batch.drop(*(drop or [])), schema)
    rows = nan_to_null(batch).dropna(subset=keys)
    try:
        target = spark.read.parquet(path)
    except AnalysisException as error:
        # a folder of which every file is empty has no schema to infer
        if not absent(error) and "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        target = None
    first = first_per_key(rows, keys, order)
    if target is None:
        write_partitioned(first.drop(*(drop or [])), path, ts)
        return
    stored = write_table(spark, first, "batch")
    write_partitioned(absent_rows(stored, target, keys, ts).drop(*(drop or [])), path, ts)
    discard(stored)


def write_partitioned(df: DataFrame, path: str, ts: str = "ts", mode: str = "append") -> None:
    """Rows laid out by year and month, so that ranges prune folders.

    Rows of a month come together first, a large month in several parts, so a task does not write a file in every month.
    """
    placed = df.withColumns({"year": F.year(ts), "month": F.month(ts)})
    clustered = df.sparkSession.sql("SELECT /*+ REBALANCE(year, month) */ * FROM {rows}", rows=placed)
    clustered.write.mode(mode).partitionBy("year", "month").parquet(path)


def without_month(df: DataFrame, ts: str, prefix: str) -> DataFrame:
    """The rows a delete by month pattern leaves (rows without a time stay)."""
    return df.where(~F.coalesce(like_prefix(F.col(ts), prefix), F.lit(False)))


def delete_month(spark: SparkSession, path: str, ts: str, prefix: str) -> None:
    """Deletes the rows of a month pattern from a table with `year` and `month` folders, in place; one writer at a time.

    Only the folders of months that hold such rows are touched: what is left of them is staged, then overwrites just these
    folders; a month of which nothing is left goes. The files of all other months stay as they are.
    """
    table = spark.read.parquet(path)
    digits = re.match(r"(\d{4})(?:-(\d{2}))?", prefix)
    inside = F.lit(True)
    if digits:
        inside = F.col("year") == int(digits[1])
        inside = inside & (F.col("month") == int(digits[2])) if digits[2] else inside
    gone = F.coalesce(like_prefix(F.col(ts), prefix), F.lit(False))
    months = table.where(inside & gone).select("year", "month").distinct().collect()  # bounded by the calendar
    if not months:
        return
    touched = F.lit(False)
    for m in months:
        touched = touched | ((F.col("year") == m["year"]) & (F.col("month") == m["month"]))
    staged = write_table(spark, table.where(touched & ~gone), "kept")
    left = {(r["year"], r["month"]) for r in staged.select("year", "month").distinct().collect()}
    if left:
        staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year", "month").parquet(path)
    for m in months:
        if (m["year"], m["month"]) not in left:
            remove_folder(spark, f"{path}/year={m['year']}/month={m['month']}")
    discard(staged)


def write_csv(df: DataFrame, folder: str, stem: str, year: date | int) -> str:
    """CSV files with a header below a folder named by year; returns the path."""
    number = year.year if isinstance(year, date) else year
    path = f"{folder.rstrip('/')}/{stem}_{number}_results.csv"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path

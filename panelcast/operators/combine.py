"""Joins of panels, region columns, bearings and unions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.functions.physics import destination_point


def join_sources(basic: DataFrame, advanced: DataFrame, keys: list[str]) -> DataFrame:
    """Rows both tables hold."""
    return basic.join(advanced, keys, "inner")


def join_or_fall_back(basic: DataFrame, advanced: DataFrame, series: str, time: str) -> DataFrame:
    """Inner join per series, or the one table that knows the series if the other is empty for it."""
    left = basic.withColumn("_b", F.lit(True))
    right = advanced.withColumn("_a", F.lit(True))
    merged = left.join(right, [series, time], "full_outer")
    # which sides a series has at all, learned from the joined rows, so neither table is read again
    whole = W.partitionBy(series)
    known = merged.withColumns({"_has_b": F.max("_b").over(whole), "_has_a": F.max("_a").over(whole)})
    keep = (F.col("_b") & F.col("_a")) | F.col("_has_b").isNull() | F.col("_has_a").isNull()
    return known.where(keep).drop("_a", "_b", "_has_a", "_has_b")


def widen_regions(
    centre: DataFrame,
    regions: DataFrame,
    names: list[str],
    columns: list[str],
    day: str = "day",
    series: str = "series_id",
) -> DataFrame:
    """Centre rows with each region's daily columns beside them.

    One conditional aggregate by day replaces a join per region: a single
    shuffle, and rows of a day combine on the map side.
    """
    wide = regions.groupBy(day).agg(
        *[F.max(F.when(F.col(series) == r, F.col(c))).alias(f"{r}_{c}") for r in names for c in columns]
    )
    return centre.join(wide, day, "left")


def common_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.select(*keys).intersect(right.select(*keys))


def rows_in_common(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys), keys, "left_semi")


def forecast_beside_actual(calendar: DataFrame, actual: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Every calendar day with what is known of it; days without either stay as NULL rows."""
    return calendar.join(actual, keys, "left").join(forecast, keys, "left")


def with_bearings(
    centres: DataFrame, lat: Column, lon: Column, distance_km: Column, bearings: dict[str, float]
) -> DataFrame:
    """Each centre row once per bearing with the point reached; the bearings are a literal, not a join."""
    points = F.array(*[F.struct(F.lit(n).alias("region"), F.lit(float(b)).alias("bearing")) for n, b in bearings.items()])
    spread = centres.withColumns({"_lat": lat, "_lon": lon, "_km": distance_km}).select("*", F.inline(points))
    end_lat, end_lon = destination_point(F.col("_lat"), F.col("_lon"), F.col("_km"), F.col("bearing"))
    return spread.withColumns({"latitude": end_lat, "longitude": end_lon}).drop("_lat", "_lon", "_km")


def stack(*frames: DataFrame) -> DataFrame:
    """UNION ALL by name; a column one frame lacks is NULL there."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def ranked_stack(*frames: DataFrame) -> DataFrame:
    """UNION ALL with `source_rank` from 1 in the order given, for precedence by `first_per_key`."""
    return stack(*[frame.withColumn("source_rank", F.lit(i)) for i, frame in enumerate(frames, 1)])


def label_union(df: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct known labels of several columns."""
    labels = df.select(F.explode(F.array(*[F.col(c).cast("int") for c in columns])).alias("label"))
    return labels.where(F.col("label").isNotNull()).distinct()

"""Wide daily features as one array per row: a centre beside its regions, lags, rolling statistics and differences.

A feature table of a thousand columns would make plans and generated code grow with it. Here a day holds one array of
values in the order of a list of names, and every step is one expression on arrays, however many values there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelcast.operators.frames import LAGS, STATISTICS, WINDOWS, by_day
from panelcast.operators.resample import daily, fill_gaps
from panelcast.schema import DAY, SERIES, TS


def value_names(spec: dict[str, list[str]]) -> list[str]:
    """The daily values of a series in the order of its array."""
    return [f"{name}_{how}" for name, hows in spec.items() for how in hows]


def daily_values(hours: DataFrame, spec: dict[str, list[str]], keys: list[str] | None = None, ts: str = TS) -> DataFrame:
    """One row per series and calendar day with `values`; days without an hour hold NULLs, sums of them 0."""
    keys = keys or [SERIES]
    days = fill_gaps(daily(hours, spec, keys, ts), keys)
    names = value_names(spec)
    # a sum over no value is 0, as in the daily aggregate
    packed = [F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n.endswith("_sum") else F.col(n).cast("double") for n in names]
    return days.select(*keys, DAY, F.array(*packed).alias("values"))


def beside_regions(days: DataFrame, neighbours: DataFrame, slots: int, width: int, series: str = SERIES, day: str = DAY) -> DataFrame:
    """Every day of a centre with `around`: the values of its regions that day, slot after slot, NULLs for a region without the day.

    neighbours: centre, slot (0 to slots - 1) and series_id. A series may be a region of many centres, and a centre itself. Days meet
    in one aggregate by centre and day of at most slots + 1 rows, which replaces a join per region.
    """
    none = F.array_repeat(F.lit(None).cast("double"), width)
    inward = days.join(neighbours.withColumnRenamed(series, "_region"), F.col(series) == F.col("_region"))
    placed = inward.select(F.col("centre").alias(series), day, F.col("slot").cast("int").alias("_slot"), "values")
    own = days.select(series, day, F.lit(-1).alias("_slot"), "values")
    met = own.unionByName(placed).groupBy(series, day).agg(F.map_from_entries(F.collect_list(F.struct("_slot", "values"))).alias("_met"))
    parts = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda k: F.coalesce(F.try_element_at("_met", k), none))
    around = F.flatten(parts) if slots else F.array().cast("array<double>")
    return met.select(series, day, F.try_element_at("_met", F.lit(-1)).alias("values"), around.alias("around")).where(F.col("values").isNotNull())


def picked(array: Column, places: list[int]) -> Column:
    """The values at the places, in their order."""
    return F.transform(F.array(*[F.lit(p) for p in places]), lambda p: F.get(array, p))


def _member(k: int) -> Callable[[Column], Column]:
    return lambda array: F.get(array, F.lit(k))


def window_arrays(
    rows: DataFrame,
    levels: Column,
    keys: list[str],
    day: str = DAY,
    lags: list[int] = LAGS,
    windows: list[int] = WINDOWS,
    size: int | None = None,
) -> DataFrame:
    """Adds `lagged`, `rolled` and `changed`: arrays over the levels for each lag, each window and statistic, and the last change.

    Statistics are over the known values of the last w rows; NULL where none is known, and a deviation of under two. All
    arrays share one exchange and one sort. `size` is the number of levels.
    """
    spec = by_day(keys, day)
    rows = rows.withColumn("_levels", levels)
    count = F.lit(size) if size is not None else F.size("_levels")
    none = F.array_repeat(F.lit(None).cast("double"), count)
    places = F.sequence(F.lit(0), count - 1)
    frames = {w: F.collect_list("_levels").over(spec.rowsBetween(-(w - 1), 0)) for w in windows}
    before = {k: F.coalesce(F.lag("_levels", k).over(spec), none) for k in sorted({1, *lags})}
    rows = rows.select(
        "*", *[f.alias(f"_frame_{w}") for w, f in frames.items()], *[b.alias(f"_lag_{k}") for k, b in before.items()]
    )

    def statistics(w: int) -> Column:
        """For each place the statistics of its known values in the frame; inner lambdas bind what is used more than once."""

        def of(known: Column) -> Column:
            many = F.size(known)
            mean = F.when(many > 0, F.aggregate(known, F.lit(0.0), lambda a, v: a + v) / many)

            def around(m: Column) -> Column:
                spread = F.aggregate(known, F.lit(0.0), lambda a, v: a + (v - m) * (v - m))
                deviation = F.when(many > 1, F.sqrt(spread / (many - 1)))
                made = {"mean": m, "min": F.array_min(known), "max": F.array_max(known), "std": deviation}
                return F.array(*[made[s] for s in STATISTICS])

            return F.transform(F.array(mean), around)[0]

        def known_at(p: Column) -> Column:
            return F.filter(F.transform(F.col(f"_frame_{w}"), lambda r: F.get(r, p)), lambda v: v.isNotNull())

        return F.transform(places, lambda p: F.transform(F.array(known_at(p)), of)[0])

    rows = rows.select("*", *[statistics(w).alias(f"_frame_stat_{w}") for w in windows])
    rolled = [F.transform(f"_frame_stat_{w}", _member(k)) for w in windows for k in range(len(STATISTICS))]
    changed = F.zip_with("_levels", "_lag_1", lambda now, then: now - then)
    kept = [c for c in rows.columns if not c.startswith(("_frame_", "_lag_")) and c != "_levels"]
    return rows.select(
        *kept, F.concat(*[F.col(f"_lag_{k}") for k in lags]).alias("lagged"), F.concat(*rolled).alias("rolled"), changed.alias("changed")
    )


def window_names(names: list[str], lags: list[int] = LAGS, windows: list[int] = WINDOWS) -> list[str]:
    """The order of `lagged`, `rolled` and `changed`, one after the other."""
    out = [f"{n}_lag_{k}" for k in lags for n in names]
    out += [f"{n}_rolling_{s}_{w}d" for w in windows for s in STATISTICS for n in names]
    return [*out, *[f"{n}_diff_1d" for n in names]]


def complete(array: str) -> Column:
    """Whether every value is known."""
    return F.forall(array, lambda v: v.isNotNull())


def next_value(array: str, place: int, keys: list[str], day: str = DAY) -> Column:
    """The value of the next row."""
    return F.lead(F.get(array, F.lit(place)), 1).over(W.partitionBy(*keys).orderBy(day))

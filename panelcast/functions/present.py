"""Text at the presentation edge, label names and small array helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the seven default weather classes.
CLASS_NAMES = {
    0: "Clear/Sunny",
    1: "Partly Cloudy",
    2: "Cloudy",
    3: "Light Rain",
    4: "Moderate Rain",
    5: "Heavy Rain",
    6: "Thunderstorms",
}


def fixed_decimals(value: Column, digits: int, missing: str = "N/A") -> Column:
    return F.coalesce(F.when(value.isNotNull(), F.format_string(f"%.{digits}f", value)), F.lit(missing))


def describe_label(
    label: Column, names: dict[int, str] = CLASS_NAMES, other: str = "Weather Type ", unknown: str = "Unknown"
) -> Column:
    """Name of a class, a numbered name for one outside the map, `unknown` for NULL."""
    number = label.cast("int")
    text = F.concat(F.lit(other), number.cast("string"))
    for key, name in names.items():
        text = F.when(number == key, F.lit(name)).otherwise(text)
    return F.coalesce(text, F.lit(unknown))


def first_known(*values: Column) -> Column:
    """Prediction, else last history, else a constant, else NULL."""
    return F.coalesce(*values)


def slice_known(values: Column, start: int, length: int) -> Column:
    """A positional slice (from 1) without its NULLs."""
    return F.filter(F.slice(values, start, length), lambda v: v.isNotNull())

"""Dew point, positions on the sphere, products and offsets."""

from __future__ import annotations

import itertools

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelcast.schema import EARTH_RADIUS_KM

# Magnus coefficients.
MAGNUS_A = 17.27
MAGNUS_B = 237.7


def clip(value: Column, low: float, high: float) -> Column:
    """NULL stays NULL (`greatest` alone would turn it into the bound)."""
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def dew_point(temperature: Column, humidity: Column) -> Column:
    gamma = F.lit(MAGNUS_A) * temperature / (F.lit(MAGNUS_B) + temperature) + F.log(clip(humidity, 1.0, 100.0) / 100.0)
    return F.lit(MAGNUS_B) * gamma / (F.lit(MAGNUS_A) - gamma)


def destination_point(
    lat: Column, lon: Column, distance_km: Column, bearing: Column, radius_km: float = EARTH_RADIUS_KM
) -> tuple[Column, Column]:
    """Latitude and longitude reached from a point along a bearing."""
    phi, theta = F.radians(lat), F.radians(bearing)
    reach = distance_km / F.lit(radius_km)
    end_phi = F.asin(F.sin(phi) * F.cos(reach) + F.cos(phi) * F.sin(reach) * F.cos(theta))
    turn = F.atan2(F.sin(theta) * F.sin(reach) * F.cos(phi), F.cos(reach) - F.sin(phi) * F.sin(end_phi))
    return F.degrees(end_phi), F.degrees(F.radians(lon) + turn)


def interactions(pairs: dict[str, tuple[str, str]]) -> dict[str, Column]:
    return {name: F.col(a) * F.col(b) for name, (a, b) in pairs.items()}


def polynomial(names: list[str], degree: int = 2) -> dict[str, Column]:
    """All products up to the degree without the constant, named by their factors."""
    terms: dict[str, Column] = {}
    for size in range(1, degree + 1):
        for combo in itertools.combinations_with_replacement(names, size):
            product = F.col(combo[0])
            for name in combo[1:]:
                product = product * F.col(name)
            terms["_x_".join(combo)] = product
    return terms


def spread_from_mean(mean: Column, up: Column | float = 3.0, down: Column | float = 3.0) -> tuple[Column, Column]:
    """Maximum and minimum around a mean, by constant or learned offsets."""
    up = up if isinstance(up, Column) else F.lit(up)
    down = down if isinstance(down, Column) else F.lit(down)
    return mean + up, mean - down

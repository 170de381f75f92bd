"""Variable lists, table schemas and the default aggregate map."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the hourly variables, their units, the eight
# neighbouring bearings and the aggregate each variable takes per day.
BASIC_VARIABLES = [
    "temperature_2m",
    "relative_humidity_2m",
    "wind_speed_10m",
    "wind_direction_10m",
    "weather_code",
    "precipitation",
    "cloud_cover",
]
ADVANCED_VARIABLES = [
    "dew_point_2m",
    "apparent_temperature",
    "pressure_msl",
    "surface_pressure",
    "rain",
    "snowfall",
    "cloud_cover_low",
    "cloud_cover_mid",
    "cloud_cover_high",
    "shortwave_radiation",
    "direct_normal_irradiance",
    "diffuse_radiation",
    "sunshine_duration",
    "wind_speed_100m",
    "wind_direction_100m",
    "wind_gusts_10m",
    "et0_fao_evapotranspiration",
    "snow_depth",
    "vapour_pressure_deficit",
    "soil_temperature_0_to_7cm",
    "soil_temperature_7_to_28cm",
    "soil_temperature_28_to_100cm",
    "soil_temperature_100_to_255cm",
    "soil_moisture_0_to_7cm",
    "soil_moisture_7_to_28cm",
    "soil_moisture_28_to_100cm",
    "soil_moisture_100_to_255cm",
]
UNITS = {
    "temperature_2m": "celsius",
    "relative_humidity_2m": "%",
    "wind_speed_10m": "km/h",
    "wind_direction_10m": "degrees",
    "weather_code": "wmo code",
    "precipitation": "mm",
    "cloud_cover": "%",
}
SUM_VARIABLES = ["precipitation", "rain", "snowfall", "sunshine_duration", "et0_fao_evapotranspiration"]
FIRST_VARIABLES = ["wind_direction_10m", "wind_direction_100m"]
LAST_VARIABLES = ["weather_code", "snow_depth"]
REGION_BEARINGS = {"N": 0.0, "NE": 45.0, "E": 90.0, "SE": 135.0, "S": 180.0, "SW": 225.0, "W": 270.0, "NW": 315.0}
CENTRE = (28.6448, 77.2167)
REGION_DISTANCE_KM = 500.0
EARTH_RADIUS_KM = 6371.0

SERIES = "series_id"
TS = "ts"
DAY = "day"


def hourly_schema(variables: list[str] = BASIC_VARIABLES) -> T.StructType:
    """Hourly table: series, local time without zone, one column per variable with its unit."""
    fields = [T.StructField(SERIES, T.StringType(), False), T.StructField(TS, T.TimestampNTZType(), False)]
    for name in unique_names(variables):
        kind = T.IntegerType() if name == "weather_code" else T.DoubleType()
        fields.append(T.StructField(name, kind, True, {"unit": UNITS.get(name, "")}))
    return T.StructType(fields)


def payload_schema(variables: list[str]) -> T.StructType:
    """Landed JSON: one object `hourly` of parallel arrays."""
    arrays = [T.StructField("time", T.ArrayType(T.StringType()))]
    arrays += [T.StructField(v, T.ArrayType(T.DoubleType())) for v in unique_names(variables)]
    return T.StructType([T.StructField("hourly", T.StructType(arrays))])


def unique_names(names: list[str]) -> list[str]:
    """Order kept, first occurrence only."""
    return list(dict.fromkeys(names))


def daily_map(variables: list[str]) -> dict[str, list[str]]:
    """Which daily aggregates each variable takes."""
    chosen: dict[str, list[str]] = {}
    for name in unique_names(variables):
        if name in SUM_VARIABLES:
            chosen[name] = ["sum"]
        elif name in FIRST_VARIABLES:
            chosen[name] = ["first"]
        elif name in LAST_VARIABLES:
            chosen[name] = ["last"]
        else:
            chosen[name] = ["mean", "min", "max"]
    return chosen

"""Silver table schemas, natural keys and column defaults."""

from __future__ import annotations

from pyspark.sql import types as T

S, D, TS, I, B = T.StringType(), T.DoubleType(), T.TimestampType(), T.IntegerType(), T.BooleanType()


def _f(name, typ, nullable=True):
    return T.StructField(name, typ, nullable)


STOP_VISIT = T.StructType([
    _f("stop_id", S, False), _f("line_id", S, False), _f("vehicle_journey_id", S),
    _f("line_name", S), _f("operator", S), _f("direction", S),
    _f("transport_mode", S, False),
    _f("aimed_arrival", TS), _f("expected_arrival", TS),
    _f("aimed_departure", TS), _f("expected_departure", TS),
    _f("arrival_status", S), _f("departure_status", S),
    _f("delay_seconds", I), _f("recorded_at", TS, False),
    _f("source", S, False), _f("inserted_at", TS, False),
])

AIR_MEASUREMENT = T.StructType([
    _f("station_id", S, False), _f("station_name", S, False),
    _f("latitude", D, False), _f("longitude", D, False), _f("aqi", I),
    _f("pm25", D), _f("pm10", D), _f("no2", D), _f("o3", D), _f("so2", D), _f("co", D),
    _f("temperature_c", D), _f("humidity_pct", D), _f("pressure_hpa", D), _f("wind_speed_ms", D),
    _f("measured_at", TS, False), _f("recorded_at", TS, False),
    _f("attribution", S), _f("source", S, False), _f("inserted_at", TS, False),
])

WEATHER_OBSERVATION = T.StructType([
    _f("point_id", S, False), _f("point_name", S, False),
    _f("latitude", D, False), _f("longitude", D, False), _f("elevation_m", D),
    _f("temperature_c", D), _f("apparent_temperature_c", D), _f("humidity_pct", D),
    _f("pressure_hpa", D), _f("surface_pressure_hpa", D), _f("cloud_cover_pct", D), _f("visibility_m", D),
    _f("precipitation_mm", D), _f("rain_mm", D), _f("showers_mm", D), _f("snowfall_cm", D),
    _f("wind_speed_ms", D), _f("wind_gusts_ms", D), _f("wind_direction_deg", D), _f("uv_index", D),
    _f("is_day", B), _f("weather_code", T.ShortType()),
    _f("aqi_european", D), _f("pm25", D), _f("pm10", D), _f("no2", D), _f("o3", D), _f("so2", D), _f("co", D),
    _f("alder_pollen", D), _f("birch_pollen", D), _f("grass_pollen", D), _f("ragweed_pollen", D),
    _f("observed_at", TS, False), _f("recorded_at", TS, False),
    _f("source", S, False), _f("inserted_at", TS, False),
])

LINE = T.StructType([
    _f("line_id", S, False), _f("short_name", S), _f("long_name", S),
    _f("transport_mode", S), _f("transport_submode", S), _f("network_name", S),
    _f("operator_name", S), _f("color_web_hex", S), _f("text_color_hex", S),
    _f("status", S), _f("accessibility", S), _f("last_refreshed_at", TS, False),
])

# Natural (load) keys: a row whose key already exists is not inserted again.
STOP_VISIT_KEY = ("stop_id", "line_id", "vehicle_journey_key", "recorded_at")
AIR_KEY = ("station_id", "measured_at")
WEATHER_KEY = ("point_id", "observed_at")
LINE_KEY = ("line_id",)

# The closed set of transport modes of the facts.
TRANSPORT_MODES = ("metro", "rer", "train", "tram", "bus", "unknown")

# Source labels stamped on each fact table.
SOURCE_STOP_VISITS = "prim"
SOURCE_AIR = "aqicn"
SOURCE_WEATHER = "open-meteo"

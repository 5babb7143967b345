"""S3: forecast (+ optional modelled air quality) responses -> weather rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.operators.common import BARRIER_COL, barrier_holds, spread

from metroscope.functions.jsonvals import parse_iso_ts, safe_bool, safe_double, safe_int, vget, vtype

# Feed members -> observation columns.
CURRENT_COLUMNS = {
    "temperature_2m": "temperature_c", "apparent_temperature": "apparent_temperature_c",
    "relative_humidity_2m": "humidity_pct", "pressure_msl": "pressure_hpa", "surface_pressure": "surface_pressure_hpa",
    "cloud_cover": "cloud_cover_pct", "visibility": "visibility_m", "precipitation": "precipitation_mm",
    "rain": "rain_mm", "showers": "showers_mm", "snowfall": "snowfall_cm", "wind_speed_10m": "wind_speed_ms",
    "wind_gusts_10m": "wind_gusts_ms", "wind_direction_10m": "wind_direction_deg",
}
AIR_COLUMNS = {
    "european_aqi": "aqi_european", "pm2_5": "pm25", "pm10": "pm10", "nitrogen_dioxide": "no2", "ozone": "o3",
    "sulphur_dioxide": "so2", "carbon_monoxide": "co", "uv_index": "uv_index", "alder_pollen": "alder_pollen",
    "birch_pollen": "birch_pollen", "grass_pollen": "grass_pollen", "ragweed_pollen": "ragweed_pollen",
}


def scan_weather(forecast: DataFrame, air_quality: DataFrame | None = None, raw: str = "raw",
                 keys: Sequence[str] = ("point_id", "fetch_id"), point_name: str = "point_name",
                 tz: str = "reference", with_rejects: bool = False):
    """``forecast`` rows carry ``keys`` + ``point_name`` + raw JSON; the
    optional ``air_quality`` rows carry ``keys`` + raw JSON.  A LEFT JOIN on
    ``keys`` keeps a forecast whose air call failed (air columns NULL).

    Rejected: no ``current`` object, no parseable time, no coordinates.
    Zone-less times are UTC (``tz="reference"``); ``tz="local"`` shifts them
    by ``utc_offset_seconds`` to true UTC.
    """
    keys = list(keys)
    fv = F.try_parse_json(F.col(raw))
    forecast = spread(forecast, barrier=True)
    extra = [BARRIER_COL] if BARRIER_COL in forecast.columns else []
    f = forecast.select(*keys, *extra, point_name, fv.alias("fv"))
    if air_quality is not None:
        a = air_quality.select(*keys, vget(F.try_parse_json(F.col(raw)), "$.current").alias("air"))
        f = f.join(a, keys, "left")
    else:
        f = f.withColumn("air", F.lit(None).cast("variant"))
    cur = vget("fv", "$.current")
    t = parse_iso_ts(vget(cur, "$.time", "string"))
    if tz == "local":
        off = F.coalesce(safe_int(vget("fv", "$.utc_offset_seconds")), F.lit(0))
        t = F.timestamp_micros(F.unix_micros(t) - off * F.lit(1_000_000))
    air_obj = F.when(vtype("air") == "OBJECT", F.col("air"))
    out = f.select(
        *keys, *extra, F.col(point_name).alias("point_name"),
        safe_double(vget("fv", "$.latitude")).alias("latitude"),
        safe_double(vget("fv", "$.longitude")).alias("longitude"),
        safe_double(vget("fv", "$.elevation")).alias("elevation_m"),
        *[safe_double(vget(cur, f"$.{k}")).alias(c) for k, c in CURRENT_COLUMNS.items()],
        safe_bool(vget(cur, "$.is_day")).alias("is_day"),
        safe_int(vget(cur, "$.weather_code")).try_cast("short").alias("weather_code"),
        *[safe_double(vget(air_obj, f"$.{k}")).alias(c) for k, c in AIR_COLUMNS.items()],
        t.alias("observed_at"), F.current_timestamp().alias("recorded_at"), F.lit("open-meteo").alias("source"),
        (vtype(cur) == "OBJECT").alias("_cur"),
    )
    valid = (F.coalesce(F.col("_cur"), F.lit(False)) & F.col("observed_at").isNotNull()
             & F.col("latitude").isNotNull() & F.col("longitude").isNotNull() & barrier_holds(out))
    if with_rejects:
        return out.filter(valid).drop("_cur", BARRIER_COL), out.filter(~valid).drop("_cur", BARRIER_COL)
    return out.filter(valid).drop("_cur", BARRIER_COL)

"""S2: air station feed responses -> air measurement rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.operators.common import BARRIER_COL, barrier_holds, spread

from metroscope.functions.jsonvals import json_loose_int, json_num, parse_iso_ts, vget, vtype

# Pollutant members of the feed -> measurement columns.
IAQI_COLUMNS = {"pm25": "pm25", "pm10": "pm10", "no2": "no2", "o3": "o3", "so2": "so2", "co": "co",
                "t": "temperature_c", "h": "humidity_pct", "p": "pressure_hpa", "w": "wind_speed_ms"}


def scan_air(bronze: DataFrame, raw: str = "raw", keep: tuple[str, ...] = ("source_file",),
             with_rejects: bool = False):
    """One response -> one measurement.  Rejected: status not ``ok``, data
    not an object, geo not two numbers, no time, no station index."""
    # parse once, then pull the members used several times into columns
    bronze = spread(bronze, barrier=True)
    keep = (*keep, *([BARRIER_COL] if BARRIER_COL in bronze.columns else []))
    doc = bronze.select(*keep, F.try_parse_json(F.col(raw)).alias("v"))
    doc = doc.select(*keep, vget("v", "$.status", "string").alias("_status"), vget("v", "$.data").alias("_data"))
    doc = doc.select(*keep, "_status", "_data", vget("_data", "$.city.geo", "array<variant>").alias("_geo"),
                     vget("_data", "$.attributions", "array<variant>").alias("_attr"))
    bronze, keep = doc, tuple(keep)
    data = F.col("_data")
    geo = F.col("_geo")
    lat = F.try_variant_get(F.get(geo, 0), "$", "double")
    lon = F.try_variant_get(F.get(geo, 1), "$", "double")
    idx = vget(data, "$.idx", "string")
    station_id = F.concat(F.lit("@"), idx)
    name = vget(data, "$.city.name", "string")
    first_attr = F.get(F.col("_attr"), 0)
    cols = [
        *keep,
        station_id.alias("station_id"),
        F.coalesce(F.nullif(name, F.lit("")), station_id).alias("station_name"),
        lat.alias("latitude"), lon.alias("longitude"),
        json_loose_int(vget(data, "$.aqi")).alias("aqi"),
        *[json_num(vget(data, f"$.iaqi.{k}")).alias(c) for k, c in IAQI_COLUMNS.items()],
        parse_iso_ts(vget(data, "$.time.iso", "string")).alias("measured_at"),
        F.current_timestamp().alias("recorded_at"),
        F.when(vtype(first_attr) == "OBJECT", vget(first_attr, "$.name", "string")).alias("attribution"),
        F.lit("aqicn").alias("source"),
    ]
    ok = ((F.col("_status") == "ok") & (vtype(data) == "OBJECT")
          & F.coalesce(F.size(geo) == 2, F.lit(False)) & lat.isNotNull() & lon.isNotNull() & idx.isNotNull())
    out = bronze.select(*cols, ok.alias("_ok"))
    valid = F.col("_ok") & F.col("measured_at").isNotNull() & barrier_holds(out)
    if with_rejects:
        return (out.filter(valid).drop("_ok", BARRIER_COL),
                out.filter(~F.coalesce(valid, F.lit(False))).drop("_ok", BARRIER_COL))
    return out.filter(valid).drop("_ok", BARRIER_COL)

"""S5: station discovery from a bounds listing and per-station feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.functions.jsonvals import vget, vtype

# Listing box (lat_min, lon_min, lat_max, lon_max).
DISCOVERY_BOX = (48.5, 1.8, 49.2, 3.1)


def discover_stations(listing: DataFrame, feeds: DataFrame, raw: str = "raw", box=DISCOVERY_BOX) -> DataFrame:
    """Stations of the listing inside the box whose feed is ``ok`` with a usable
    AQI (not ``-``/NULL).  ``listing`` rows are listing entries as JSON
    (``uid``, ``lat``, ``lon``); ``feeds`` rows are ``uid`` + raw feed JSON.
    Sorted by latitude then longitude (non-numeric -> 0.0)."""
    lat_min, lon_min, lat_max, lon_max = box
    lv = F.try_parse_json(F.col(raw))
    lst = listing.select(vget(lv, "$.uid", "string").alias("uid"), vget(lv, "$.lat", "double").alias("lat"),
                         vget(lv, "$.lon", "double").alias("lon"))
    lst = lst.filter(F.col("uid").isNotNull() & F.col("lat").between(lat_min, lat_max)
                     & F.col("lon").between(lon_min, lon_max))
    fv = F.try_parse_json(F.col(raw))
    fd = feeds.select(F.col("uid").cast("string").alias("uid"), vget(fv, "$.status", "string").alias("status"),
                      vget(fv, "$.data").alias("data"))
    aqi = vget("data", "$.aqi", "string")
    geo = vget("data", "$.city.geo", "array<variant>")
    first_attr = F.get(vget("data", "$.attributions", "array<variant>"), 0)
    ok = fd.filter((F.col("status") == "ok") & aqi.isNotNull() & (aqi != "-"))
    out = lst.select("uid").join(ok, "uid").select(
        F.concat(F.lit("@"), F.col("uid")).alias("uid"),
        F.coalesce(vget("data", "$.city.name", "string"), F.lit("?")).alias("name"),
        F.try_variant_get(F.get(geo, 0), "$", "double").alias("latitude"),
        F.try_variant_get(F.get(geo, 1), "$", "double").alias("longitude"),
        aqi.alias("aqi"),
        F.coalesce(F.when(vtype(first_attr) == "OBJECT", vget(first_attr, "$.name", "string")), F.lit("?")).alias("attribution"),
    )
    return out.orderBy(F.coalesce("latitude", F.lit(0.0)), F.coalesce("longitude", F.lit(0.0)), "uid")

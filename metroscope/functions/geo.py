"""Great-circle distance and bounding-box predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius used for every distance, in km.
EARTH_RADIUS_KM = 6371.0

# The region box (inclusive) used to reject foreign sensors.
REGION_BOX = {"lat_min": 48.0, "lat_max": 50.0, "lon_min": 1.5, "lon_max": 3.5}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def haversine_km(lat1, lon1, lat2, lon2, cos1=None, cos2=None) -> Column:
    """Haversine distance in km between two (lat, lon) points in degrees.

    The sqrt argument is clamped at 1.0 so antipodal rounding never yields NaN.
    ``cos1`` and ``cos2``: the latitudes' cosines, where a pair join has stored them.
    """
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    s_dlat = F.sin(F.radians(lat2 - lat1) / 2.0)
    s_dlon = F.sin(F.radians(lon2 - lon1) / 2.0)
    cos1, cos2 = (F.cos(F.radians(lat)) if cos is None else _c(cos) for lat, cos in ((lat1, cos1), (lat2, cos2)))
    a = s_dlat * s_dlat + cos1 * cos2 * (s_dlon * s_dlon)
    return F.lit(EARTH_RADIUS_KM) * (F.lit(2.0) * F.asin(F.sqrt(F.least(a, F.lit(1.0)))))


def in_bbox(lat, lon, box: dict | None = None) -> Column:
    """Inclusive box test; a NULL coordinate gives false (never NULL)."""
    b = box or REGION_BOX
    lat, lon = _c(lat), _c(lon)
    return F.coalesce(lat.between(b["lat_min"], b["lat_max"]) & lon.between(b["lon_min"], b["lon_max"]),
                      F.lit(False))

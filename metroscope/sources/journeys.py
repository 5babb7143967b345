"""S8: journey specs ``id:label:lat,lon:lat,lon...`` -> journeys and waypoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POINT_RE = r"^\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*,\s*([-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)\s*$"


def parse_journey_specs(specs: DataFrame, spec: str = "spec"):
    """Return ``(journeys, waypoints, rejects)``.

    A spec needs at least 4 ``:`` parts (two waypoints); every point must be
    ``lat,lon`` numbers.  Bad specs go to ``rejects`` with a reason instead of
    failing the job.
    """
    parts = F.split(F.col(spec), ":")
    pts = F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0)))
    parsed = specs.select(F.col(spec), F.get(parts, 0).alias("journey_id"), F.get(parts, 1).alias("journey_label"),
                          F.size(parts).alias("n_parts"), pts.alias("pts"))
    bad_point = F.exists("pts", lambda p: ~p.rlike(POINT_RE))
    parsed = parsed.withColumn("reason", F.when(F.col("n_parts") < 4, F.lit("needs id:label and two waypoints"))
                               .when(bad_point, F.lit("point is not lat,lon")))
    ok = parsed.filter(F.col("reason").isNull())
    journeys = ok.select("journey_id", "journey_label",
                         F.transform("pts", lambda p: F.struct(
                             F.regexp_extract(p, POINT_RE, 1).try_cast("double").alias("latitude"),
                             F.regexp_extract(p, POINT_RE, 2).try_cast("double").alias("longitude"))).alias("waypoints"))
    waypoints = journeys.select("journey_id", F.posexplode("waypoints").alias("pos", "w")).select(
        "journey_id", "pos", F.col("w.latitude").alias("latitude"), F.col("w.longitude").alias("longitude"))
    return journeys, waypoints, parsed.filter(F.col("reason").isNotNull()).select(spec, "reason")


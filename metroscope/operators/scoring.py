"""Journey health scoring: waypoint exposure -> journey score -> comparison.

All journeys of a request table are scored in one plan against ONE snapshot
taken at ``as_of`` (the reference re-reads the database per journey).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metroscope.functions import formats
from metroscope.functions.scores import (
    DEFAULT_WEIGHTS, aggregate_scores, grade, pollution_score, traffic_score, weather_score,
)
from metroscope.operators.common import materialize
from metroscope.operators.snapshots import as_of_value, latest_air, latest_weather, trailing
from metroscope.operators.spatial import nearest

# Representativeness limit and warning texts.
MAX_REPRESENTATIVE_DISTANCE_KM = 5.0
WARN_FAR_STATION = "Station de pollution la plus proche à {} km (>5.0 km), score peu représentatif"
WARN_NO_AIR = "Aucune donnée de pollution récente disponible"
WARN_NO_WEATHER = "Aucune donnée météo récente disponible"
TRAFFIC_WINDOW_HOURS = 24
SIGNIFICANT_GAP = 5.0


def traffic_stats(visits: DataFrame, as_of=None, hours: float = TRAFFIC_WINDOW_HOURS) -> DataFrame:
    """One row: mean stored delay and sample count over the trailing window."""
    v = trailing(visits, "recorded_at", as_of, hours=hours).filter(F.col("delay_seconds").isNotNull())
    return v.agg(F.avg(F.col("delay_seconds").cast("double")).alias("avg_delay_seconds"),
                 F.count(F.lit(1)).cast("int").alias("sample_count"))


def score_waypoints(waypoints: DataFrame, air_snapshot: DataFrame, weather_snapshot: DataFrame,
                    traffic: DataFrame, keys: Sequence[str] = ("journey_id", "pos"),
                    strategy: str = "auto") -> DataFrame:
    """Per-waypoint exposure (nearest air station, nearest weather point, the
    global traffic row) and its three sub-scores plus the default-weight total."""
    air = air_snapshot.select(F.col("station_id").alias("sensor_id"), "latitude", "longitude", "pm25", "no2", "aqi")
    wx = weather_snapshot.select(F.col("point_id").alias("sensor_id"), "latitude", "longitude", "temperature_c",
                                 "precipitation_mm", "wind_speed_ms", "uv_index")
    w = nearest(waypoints, air, keys, payload=["pm25", "no2", "aqi"], prefix="air_", strategy=strategy)
    w = nearest(w, wx, keys, payload=["temperature_c", "precipitation_mm", "wind_speed_ms", "uv_index"],
                prefix="wx_", strategy=strategy)
    # the global traffic row is a one-row aggregate: attach it as scalar subqueries
    avg_delay = traffic.select("avg_delay_seconds").scalar()
    n = traffic.select("sample_count").scalar()
    w = w.withColumn("traffic_avg_delay_seconds", avg_delay).withColumn("traffic_sample_count", n)
    p = pollution_score("air_pm25", "air_no2", "air_aqi")
    wsc = weather_score("wx_temperature_c", "wx_precipitation_mm", "wx_wind_speed_ms", "wx_uv_index")
    t = traffic_score("traffic_avg_delay_seconds", "traffic_sample_count")
    w = (w.withColumn("pollution_score", p).withColumn("weather_score", wsc).withColumn("traffic_score", t)
          .withColumn("overall_score", aggregate_scores("pollution_score", "weather_score", "traffic_score")))
    far = F.col("air_distance_km") > F.lit(MAX_REPRESENTATIVE_DISTANCE_KM)
    pre, _, post = WARN_FAR_STATION.partition("{}")
    return w.withColumn("warning", F.when(far, F.concat(F.lit(pre), formats.fmt_fixed("air_distance_km", 1),
                                                          F.lit(post))))


def _empty_flag(df: DataFrame) -> Column:
    return df.select((F.count(F.lit(1)) == 0).alias("e")).scalar()


def score_journeys(journeys: DataFrame, waypoints: DataFrame, air: DataFrame, weather: DataFrame,
                   visits: DataFrame, as_of=None, weights: dict | None = None,
                   strategy: str = "auto", exposures: DataFrame | None = None) -> DataFrame:
    """Score every journey: means of the waypoint sub-scores, the weighted
    total (custom weights apply to the journey total only), grade and sorted
    distinct warnings.  Journeys without waypoints get no row (see
    ``invalid_journeys``)."""
    weights = weights or DEFAULT_WEIGHTS
    # one snapshot per source for every journey, materialized once (bounded by the sensor count)
    air_snap = materialize(latest_air(air, as_of))
    wx_snap = materialize(latest_weather(weather, as_of))
    if exposures is None:
        exposures = score_waypoints(waypoints, air_snap, wx_snap, traffic_stats(visits, as_of), strategy=strategy)
    agg = exposures.groupBy("journey_id").agg(
        F.count(F.lit(1)).alias("n_waypoints"),
        F.avg("pollution_score").alias("pollution_score"),
        F.avg("weather_score").alias("weather_score"),
        F.avg("traffic_score").alias("traffic_score"),
        F.collect_set("warning").alias("_w"),
    )
    no_data = F.array_compact(F.array(F.when(_empty_flag(air_snap), F.lit(WARN_NO_AIR)),
                                      F.when(_empty_flag(wx_snap), F.lit(WARN_NO_WEATHER))))
    agg = agg.withColumn("warnings", F.sort_array(F.array_distinct(F.concat("_w", no_data)))).drop("_w")
    out = journeys.join(agg, "journey_id")
    total = aggregate_scores("pollution_score", "weather_score", "traffic_score", weights)
    return (out.withColumn("overall_score", total)
               .withColumn("grade", grade("overall_score"))
               .withColumn("evaluated_at", as_of_value(as_of))
               .withColumn("weights", F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])))


REJECT_EMPTY = "Le trajet doit avoir au moins un waypoint"
REJECT_SAME = "Le départ et l'arrivée sont identiques — choisis 2 zones différentes."
REJECT_ALONE = "[NO_DATA] Il faut au moins 2 trajets à comparer."


def invalid_journeys(journeys: DataFrame, waypoints: DataFrame) -> DataFrame:
    """Journeys that cannot be scored, with the reason: no waypoint, or a
    start equal to the end (first and last of several waypoints)."""
    at = lambda p: F.struct(F.col(p + ".latitude"), F.col(p + ".longitude"))
    row = F.struct("pos", "latitude", "longitude")
    ends = (waypoints.groupBy("journey_id").agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("a"), F.max(row).alias("b"))
            .select("journey_id", ((F.col("n") > 1) & (at("a") == at("b"))).alias("same")))
    return (journeys.join(ends, "journey_id", "left")
            .withColumn("reason", F.when(F.col("same").isNull(), F.lit(REJECT_EMPTY)).when(F.col("same"), F.lit(REJECT_SAME)))
            .filter(F.col("reason").isNotNull()).drop("same"))


def invalid_comparisons(journeys: DataFrame, group_col: str = "comparison_id") -> DataFrame:
    """Comparisons of fewer than two journeys, with the reason."""
    return (journeys.groupBy(group_col).agg(F.count(F.lit(1)).alias("n_journeys")).filter("n_journeys < 2")
            .withColumn("reason", F.lit(REJECT_ALONE)))


def nest_journeys(scored: DataFrame, exposures: DataFrame) -> DataFrame:
    """Nested result: each journey with its ordered list of waypoint exposures.

    The list holds one struct per waypoint of that journey: it is meant for
    journeys a person requests.  For journeys of unbounded length read the
    exposures themselves, one row per waypoint.
    """
    cols = ["latitude", "longitude", "pollution_score", "weather_score", "traffic_score", "overall_score",
            "air_id", "air_distance_km", "air_pm25", "air_no2", "air_aqi", "wx_id", "wx_distance_km",
            "wx_temperature_c", "wx_precipitation_mm", "wx_wind_speed_ms", "wx_uv_index"]
    ex = exposures.groupBy("journey_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), F.struct(*cols).alias("e")))).alias("_l"))
    ex = ex.select("journey_id", F.transform("_l", lambda x: x["e"]).alias("waypoints"))
    return scored.join(ex, "journey_id")


def compare_journeys(scored: DataFrame, group_col: str = "comparison_id", pos_col: str = "input_pos") -> DataFrame:
    """Best / worst journey per comparison, score gap and significance.

    Ties go to the journey listed first (smallest ``pos_col``), as with a
    first-max scan.  Plain partial aggregates: a huge comparison group is
    pre-reduced map-side.
    """
    s = scored.select(group_col, "journey_id", pos_col, "overall_score")
    out = s.groupBy(group_col).agg(
        F.count(F.lit(1)).alias("n_journeys"),
        F.max(F.struct(F.col("overall_score"), (-F.col(pos_col)).alias("neg_pos"), F.col("journey_id"))).alias("_b"),
        F.min(F.struct(F.col("overall_score"), F.col(pos_col), F.col("journey_id"))).alias("_w"),
    )
    return out.select(group_col, "n_journeys",
                      F.col("_b.journey_id").alias("best_journey_id"),
                      F.col("_w.journey_id").alias("worst_journey_id"),
                      (F.col("_b.overall_score") - F.col("_w.overall_score")).alias("score_gap"),
                      ((F.col("_b.overall_score") - F.col("_w.overall_score")) >= SIGNIFICANT_GAP).alias("is_significant"))


def rank_journeys(scored: DataFrame, group_col: str = "comparison_id", pos_col: str = "input_pos") -> DataFrame:
    """1-based rank of each journey in its comparison by descending score,
    ties in listing order; distributed even for a very large comparison.

    The ranking reads its input three times (range bounds, slice sizes,
    numbering), so the scored journeys (one row per journey) are written once
    to the checkpoint folder first instead of being re-scored each time."""
    from metroscope.operators.ranking import rank_within
    return rank_within(materialize(scored), [group_col], [F.col("overall_score").desc(), F.col(pos_col)])

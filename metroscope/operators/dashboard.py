"""Dashboard and assistant reads over snapshots: name filters, map layer, station table, score gate."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.functions import formats as fm


def name_contains(snapshot: DataFrame, needle: str, cols: Sequence[str]) -> DataFrame:
    """Rows with ``needle`` in any of ``cols``, ignoring case; a NULL value contains only the empty needle.

    One needle is one pass over the rows; for many needles use ``substrings.matches``.
    """
    return snapshot.filter(reduce(or_, [F.lower(F.coalesce(c, F.lit(""))).contains(needle.lower()) for c in cols]))


def map_layer(snapshot: DataFrame) -> DataFrame:
    """Marker rows of the stations that have coordinates: place, AQI colour, label."""
    placed = snapshot.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return placed.select("latitude", "longitude", fm.aqi_color("aqi").alias("color"), F.col("station_name").alias("label"))


def station_table(snapshot: DataFrame) -> DataFrame:
    """Station table of the air page: AQI with label, rounded PM2.5 / NO2, display column names."""
    rounded = lambda c: F.when(F.col(c).isNull(), F.lit("—")).otherwise(fm.fmt_fixed(c, 0))
    aqi = F.when(F.col("aqi").isNull(), F.lit("?")).otherwise(F.concat(F.col("aqi").cast("string"), F.lit(" — "), fm.aqi_label("aqi")))
    return snapshot.select(F.col("station_name").alias("Station"), aqi.alias("AQI"), rounded("pm25").alias("PM2.5"),
                           rounded("no2").alias("NO₂"), F.col("attribution").alias("Source"))


def score_range_check(scored: DataFrame, cols: Sequence[str] = ("pollution_score", "weather_score", "traffic_score")) -> DataFrame:
    """One row: rows checked, and rows with a score outside 0..100 (a missing score is not outside)."""
    outside = reduce(or_, [~F.col(c).between(0, 100) for c in cols])
    return scored.agg(F.count(F.lit(1)).alias("checked"), F.count_if(outside).alias("rejected"))


def poll_coverage(facts: DataFrame, listed: DataFrame, key: str, ts: str) -> DataFrame:
    """Per id of ``listed`` (unique): rows and latest time in ``facts``, 0 and NULL without any; one row with a NULL id
    for the facts of every other id.

    Facts are reduced to one row per id before they meet the list.
    """
    seen = facts.groupBy(F.col(key).alias("__id")).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("last"))
    both = seen.join(listed.select(key), F.col("__id") == F.col(key), "full")
    return both.groupBy(key).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.max("last").alias("latest"))

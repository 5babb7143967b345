"""Delay analytics and ingestion reports over the fact tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.functions.geo import REGION_BOX, in_bbox
from metroscope.functions.mobility import arrival_delay_seconds
from metroscope.operators.common import broadcast_if_small
from metroscope.operators.snapshots import trailing

LATE_THRESHOLD_S = 60          # fixed value: "late" means more than 60 s
MIN_LINE_VISITS = 5            # fixed value: league table HAVING count >= 5
UNKNOWN_MODE_LABEL = "Inconnu"  # fixed value: mode label of unknown lines


def recent_arrivals(visits: DataFrame, as_of=None, hours: float = 24) -> DataFrame:
    """Visits of the window with both arrival times, with the fractional
    arrival delay ``delay_sec``."""
    v = trailing(visits, "recorded_at", as_of, hours=hours)
    v = v.filter(F.col("aimed_arrival").isNotNull() & F.col("expected_arrival").isNotNull())
    return v.withColumn("delay_sec", arrival_delay_seconds())


def traffic_kpis(visits: DataFrame, as_of=None, hours: float = 24) -> DataFrame:
    """One row: visits, distinct lines, mean delay and % late (> 60 s) over the
    trailing window (24 h in the dashboard)."""
    r = recent_arrivals(visits, as_of, hours)
    n = F.count(F.lit(1))
    row = r.agg(n.alias("total_visits"), F.count_distinct("line_id").alias("active_lines"),
                F.avg("delay_sec").alias("avg_delay_sec"),
                (F.count_if(F.col("delay_sec") > LATE_THRESHOLD_S).cast("double") * F.lit(100.0)
                 / F.nullif(n, F.lit(0)).cast("double")).alias("pct_late"))
    return row.select(F.coalesce("total_visits", F.lit(0)).alias("total_visits"),
                      F.coalesce("active_lines", F.lit(0)).alias("active_lines"),
                      F.coalesce("avg_delay_sec", F.lit(0.0)).alias("avg_delay_sec"),
                      F.coalesce("pct_late", F.lit(0.0)).alias("pct_late"))


def _with_lines(r: DataFrame, lines: DataFrame, mode: str | None) -> DataFrame:
    dim = broadcast_if_small(lines.select("line_id", "short_name", "transport_mode"))
    j = r.join(dim, "line_id", "left")
    if mode:
        # a filter on the dimension after the LEFT JOIN drops unknown lines (as the reference does)
        j = j.filter(F.col("transport_mode") == mode)
    return j


def top_delayed(visits: DataFrame, lines: DataFrame, as_of=None, limit: int = 10, mode: str | None = None,
                hours: float = 24) -> DataFrame:
    """League of lines by mean arrival delay over the trailing window (24 h in
    the dashboard; >= 5 visits), top N.  Ties on the mean are broken by line
    id so the cut is deterministic."""
    g = (recent_arrivals(visits, as_of, hours).groupBy("line_id")
         .agg(F.count(F.lit(1)).alias("visits"), F.avg("delay_sec").alias("avg_delay_sec"))
         .filter(F.col("visits") >= MIN_LINE_VISITS))
    # one row per line meets the dimension, not one per visit
    g = _with_lines(g, lines, mode)
    g = g.select("line_id", F.coalesce("short_name", "line_id").alias("line_name"),
                 F.coalesce("transport_mode", F.lit(UNKNOWN_MODE_LABEL)).alias("transport_mode"),
                 "visits", "avg_delay_sec")
    return g.orderBy(F.col("avg_delay_sec").desc(), F.col("line_id")).limit(limit)


def top_delayed_display(top: DataFrame) -> DataFrame:
    """Bar-chart rows: delay in minutes, ``name (mode)`` label, ascending."""
    return (top.select(F.concat(F.col("line_name"), F.lit(" ("), F.col("transport_mode"), F.lit(")")).alias("label"),
                       (F.col("avg_delay_sec") / F.lit(60.0)).alias("delay_min"), "line_id")
            .orderBy("delay_min", "line_id"))


def delay_heatmap(visits: DataFrame, lines: DataFrame, as_of=None, mode: str | None = None,
                  hours: float = 24 * 7) -> DataFrame:
    """Mean arrival delay and count by day of week (0 = Sunday) x hour over the
    trailing window (7 days in the dashboard)."""
    r = recent_arrivals(visits, as_of, hours)
    if mode:
        r = _with_lines(r.select("line_id", "recorded_at", "delay_sec"), lines, mode)
    return (r.groupBy((F.dayofweek("recorded_at") - 1).alias("day_of_week"), F.hour("recorded_at").alias("hour"))
            .agg(F.avg("delay_sec").alias("avg_delay_sec"), F.count(F.lit(1)).alias("visits")))


def heatmap_grid(heat: DataFrame) -> DataFrame:
    """Full 7 x 24 grid of mean delay in minutes; missing cells stay NULL."""
    hours = list(range(24))
    piv = heat.groupBy("day_of_week").pivot("hour", hours).agg(F.first(F.col("avg_delay_sec") / F.lit(60.0)))
    days = heat.sparkSession.range(7).select(F.col("id").cast("int").alias("day_of_week"))
    out = days.join(piv, "day_of_week", "left")
    return out.select("day_of_week", *[F.col(str(h)).alias(f"h{h:02d}") for h in hours])


def traffic_overview(visits: DataFrame, as_of=None, hours: float = 2) -> DataFrame:
    """Recent overview: samples, mean stored delay, distinct lines, latest."""
    v = trailing(visits, "recorded_at", as_of, hours=hours).filter(F.col("delay_seconds").isNotNull())
    return v.agg(F.count(F.lit(1)).alias("total_samples"),
                 F.avg(F.col("delay_seconds").cast("double")).alias("overall_avg_delay"),
                 F.count_distinct("line_id").alias("distinct_lines"), F.max("recorded_at").alias("latest"))


def line_stats(visits: DataFrame, lines: DataFrame, names: DataFrame, as_of=None, hours: float = 2) -> DataFrame:
    """Per requested short name: lines matched case-insensitively, then the
    count, mean stored delay and latest time of their visits (2 h).

    The label comes from the matching line with the smallest id.  A name
    matching no line is kept with ``matched = false``.
    """
    dim = lines.select("line_id", "short_name", "transport_mode", "network_name")
    pairs = names.select("name").distinct().join(
        dim, F.lower(F.col("name")) == F.lower(F.col("short_name")), "left")
    info = pairs.groupBy("name").agg(
        F.min(F.struct("line_id", "short_name", "transport_mode", "network_name")).alias("info"),
        F.count("line_id").alias("n_lines"))
    v = trailing(visits, "recorded_at", as_of, hours=hours).filter(F.col("delay_seconds").isNotNull())
    matched = pairs.filter(F.col("line_id").isNotNull()).select("name", "line_id")
    stats = (v.select("line_id", "delay_seconds", "recorded_at")
             .join(broadcast_if_small(matched), "line_id")
             .groupBy("name").agg(F.count(F.lit(1)).alias("samples"),
                                  F.avg(F.col("delay_seconds").cast("double")).alias("avg_delay"),
                                  F.max("recorded_at").alias("latest")))
    out = info.join(stats, "name", "left")
    return out.select("name", (F.col("n_lines") > 0).alias("matched"), "n_lines",
                      F.col("info.short_name").alias("short_name"), F.col("info.transport_mode").alias("transport_mode"),
                      F.col("info.network_name").alias("network_name"),
                      F.coalesce("samples", F.lit(0)).alias("samples"), "avg_delay", "latest")


def ingestion_history(visits: DataFrame, air: DataFrame, weather: DataFrame, as_of=None, hours: float = 24) -> DataFrame:
    """Rows per hour and source over the window (three counts, UNION ALL)."""
    def hourly(df, ts, label):
        return (trailing(df, ts, as_of, hours=hours).groupBy(F.date_trunc("hour", ts).alias("hour"))
                .agg(F.count(F.lit(1)).alias("count")).withColumn("source", F.lit(label)))
    return (hourly(visits, "recorded_at", "PRIM IDFM")
            .unionByName(hourly(air, "measured_at", "AQICN"))
            .unionByName(hourly(weather, "observed_at", "Open-Meteo"))
            .select("hour", "source", "count").orderBy("hour", "source"))


def global_stats(visits: DataFrame, air: DataFrame, weather: DataFrame, lines: DataFrame) -> DataFrame:
    """One row: four table counts and the three latest event times."""
    a = visits.agg(F.count(F.lit(1)).alias("stop_visits_count"), F.max("recorded_at").alias("last_stop_visit"))
    b = air.agg(F.count(F.lit(1)).alias("air_count"), F.max("measured_at").alias("last_air"))
    c = weather.agg(F.count(F.lit(1)).alias("weather_count"), F.max("observed_at").alias("last_weather"))
    d = lines.agg(F.count(F.lit(1)).alias("lines_count"))
    # four one-row aggregates side by side, as scalar subqueries
    return a.select(
        "stop_visits_count", b.select("air_count").scalar().alias("air_count"),
        c.select("weather_count").scalar().alias("weather_count"), d.select("lines_count").scalar().alias("lines_count"),
        "last_stop_visit", b.select("last_air").scalar().alias("last_air"),
        c.select("last_weather").scalar().alias("last_weather"))


def available_modes(lines: DataFrame) -> DataFrame:
    return lines.select("transport_mode").filter(F.col("transport_mode").isNotNull()).distinct().orderBy("transport_mode")


def station_history(air: DataFrame, as_of=None, hours: float = 48, station_id: str | None = None) -> DataFrame:
    a = trailing(air, "measured_at", as_of, hours=hours)
    if station_id is not None:
        a = a.filter(F.col("station_id") == station_id)
    return a.select("station_id", "station_name", "aqi", "pm25", "pm10", "no2", "measured_at").orderBy("measured_at")


def bad_stations(air: DataFrame, box: dict | None = None) -> DataFrame:
    """Stations measured outside the region box, most rows first."""
    out = air.filter(~in_bbox("latitude", "longitude", box))
    return (out.groupBy("station_id", "station_name", "latitude", "longitude")
            .agg(F.count(F.lit(1)).alias("n_rows"), F.min("measured_at").alias("first_seen"),
                 F.max("measured_at").alias("last_seen"))
            .orderBy(F.col("n_rows").desc(), "station_id"))


def bbox_audit(air: DataFrame) -> DataFrame:
    return air.agg(F.count(F.lit(1)).alias("n_rows"), F.min("latitude").alias("min_lat"),
                   F.max("latitude").alias("max_lat"), F.min("longitude").alias("min_lon"),
                   F.max("longitude").alias("max_lon"))


def air_kpis(snapshot: DataFrame) -> DataFrame:
    """Air page KPIs over the snapshot (NULLs skipped in the means)."""
    return snapshot.agg(F.count(F.lit(1)).alias("stations"), F.avg("aqi").alias("mean_aqi"),
                        F.avg("pm25").alias("mean_pm25"), F.max("measured_at").alias("latest"))


def enrich_visits(visits: DataFrame, lines: DataFrame, as_of=None, hours: float | None = 24) -> DataFrame:
    """Recent facts LEFT JOIN the line dimension: display name and mode fall
    back to the fact's own values; newest first.

    Only the trailing window is joined and ordered; ``hours=None`` enriches
    every row and leaves them unordered (ordering a whole fact table is no
    report).
    """
    dim = lines.select("line_id", F.col("short_name").alias("dim_short_name"), F.col("transport_mode").alias("dim_mode"),
                       "network_name", "color_web_hex")
    recent = visits if hours is None else trailing(visits, "recorded_at", as_of, hours=hours)
    j = (recent.join(dim, "line_id", "left")
         .withColumn("display_line_name", F.coalesce("dim_short_name", "line_name", "line_id"))
         .withColumn("display_mode", F.coalesce("dim_mode", "transport_mode")))
    return j if hours is None else j.orderBy(F.col("recorded_at").desc(), "stop_id", "line_id")


def known_lines(visits: DataFrame, lines: DataFrame) -> DataFrame:
    return visits.join(broadcast_if_small(lines.select("line_id")), "line_id", "left_semi")


def unknown_lines(visits: DataFrame, lines: DataFrame) -> DataFrame:
    return visits.join(broadcast_if_small(lines.select("line_id")), "line_id", "left_anti")


def in_region(df: DataFrame, box: dict | None = None) -> DataFrame:
    return df.filter(in_bbox("latitude", "longitude", box or REGION_BOX))

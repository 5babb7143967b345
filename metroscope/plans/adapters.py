"""Logical tables over the driver's test tables.

The driver ships TPC-H-like tables, not transit feeds.  These views give rows
in the shapes the library's jobs expect (stop visits, air measurements,
weather observations, the line dimension, journeys) using integer/timestamp
arithmetic that Spark and DuckDB compute identically.  They do none of the
jobs' work: delays, snapshots, distances and scores are computed later by
the library's own code (and, independently, by the oracle SQL).

Each view exists twice: a Spark DataFrame builder and a DuckDB SQL text used
by ``oracle_sql()``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Evaluation time of every registered query.  Events end on 2024-01-30, so a
# real clock would leave every trailing window empty.
AS_OF = "2024-01-31 00:00:00"

# Fixture values: place names used to label stations and weather points.
PLACE_NAMES = ["Paris Centre", "La Défense", "Gare du Nord", "Saint-Denis", "Versailles",
               "Créteil", "Boulogne", "Vitry", "Argenteuil", "Cergy"]
MODES_BY_USER = ["metro", "rer", "train", "tram", "bus", "unknown"]
OPERATORS_BY_USER = ["RATP", "SNCF", "Transdev", None]
LINE_MODE_BY_PART_TYPE = {"ECONOMY": "Metro", "LARGE": "RER", "MEDIUM": "Tram", "PROMO": "Bus", "SMALL": "Train"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of_col():
    return F.lit(AS_OF).cast("timestamp")


def _plus_seconds(ts, secs):
    return F.timestamp_micros(F.unix_micros(ts) + secs * F.lit(1_000_000))


def _pick(idx, values):
    expr = None
    for i, v in enumerate(values):
        lit = F.lit(v) if v is not None else F.lit(None).cast("string")
        expr = F.when(idx == i, lit) if expr is None else expr.when(idx == i, lit)
    return expr


def _sql_pick(idx: str, values) -> str:
    arms = " ".join(f"WHEN {i} THEN " + ("NULL" if v is None else "'" + v.replace("'", "''") + "'")
                    for i, v in enumerate(values))
    return f"(CASE {idx} {arms} END)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    # parquet holds zone-less timestamps; the facts use session-zone (UTC) ones
    from metroscope.operators.common import spread
    return spread(table(spark, sf_dir, "events")).select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                                                          "user_id", "event_type", "value")


# --------------------------------------------------------------------------- stop visits
def stop_visits_raw(spark: SparkSession, sf_dir: str, with_event_id: bool = False) -> DataFrame:
    """Parsed stop visits (before load): one per event."""
    e = _events(spark, sf_dir)
    lk = (F.col("user_id") * 17).cast("string")
    return e.select(*(["event_id"] if with_event_id else []),
        F.concat(F.lit("STIF:StopPoint:Q:"), (F.col("event_id") % 97).cast("string"), F.lit(":")).alias("stop_id"),
        F.concat(F.lit("STIF:Line::C"), lk, F.lit(":")).alias("line_id"),
        F.when(F.col("event_id") % 3 != 0, F.col("event_id").cast("string")).alias("vehicle_journey_id"),
        F.concat(F.lit("L"), lk).alias("line_name"),
        _pick(F.col("user_id") % 4, OPERATORS_BY_USER).alias("operator"),
        F.concat(F.lit("Terminus "), (F.col("event_id") % 7).cast("string")).alias("direction"),
        _pick(F.col("user_id") % 6, MODES_BY_USER).alias("transport_mode"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("aimed_arrival"),
        F.when(~F.col("event_type").isin("signup", "error"),
               _plus_seconds(F.col("ts"), F.floor(F.col("value") * 4) - 60)).alias("expected_arrival"),
        _plus_seconds(F.col("ts"), F.lit(30)).alias("aimed_departure"),
        F.when(F.col("event_type") != "view",
               _plus_seconds(F.col("ts"), F.floor(F.col("value") * 2) + 10)).alias("expected_departure"),
        F.when(F.col("event_type") == "error", F.lit("cancelled")).otherwise(F.lit("onTime")).alias("arrival_status"),
        F.lit(None).cast("string").alias("departure_status"),
        F.col("ts").alias("recorded_at"),
        F.lit("prim").alias("source"),
    )


SQL_STOP_VISITS_RAW = f"""
SELECT 'STIF:StopPoint:Q:' || CAST(event_id % 97 AS VARCHAR) || ':' AS stop_id,
       'STIF:Line::C' || CAST(user_id * 17 AS VARCHAR) || ':' AS line_id,
       CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS VARCHAR) END AS vehicle_journey_id,
       'L' || CAST(user_id * 17 AS VARCHAR) AS line_name,
       {_sql_pick('user_id % 4', OPERATORS_BY_USER)} AS operator,
       'Terminus ' || CAST(event_id % 7 AS VARCHAR) AS direction,
       {_sql_pick('user_id % 6', MODES_BY_USER)} AS transport_mode,
       CASE WHEN event_type <> 'signup' THEN ts END AS aimed_arrival,
       CASE WHEN event_type NOT IN ('signup', 'error')
            THEN ts + to_seconds(CAST(floor(value * 4) AS BIGINT) - 60) END AS expected_arrival,
       ts + to_seconds(30) AS aimed_departure,
       CASE WHEN event_type <> 'view' THEN ts + to_seconds(CAST(floor(value * 2) AS BIGINT) + 10) END
            AS expected_departure,
       CASE WHEN event_type = 'error' THEN 'cancelled' ELSE 'onTime' END AS arrival_status,
       CAST(NULL AS VARCHAR) AS departure_status,
       ts AS recorded_at, 'prim' AS source
FROM events"""

# Loaded (silver) stop visits as the oracle computes them: stored delay =
# arrival pair else departure pair, whole seconds truncated toward zero.
SQL_STOP_VISITS = f"""
SELECT r.*,
       CAST(CASE WHEN aimed_arrival IS NOT NULL AND expected_arrival IS NOT NULL
                 THEN trunc((epoch_us(expected_arrival) - epoch_us(aimed_arrival)) / 1000000.0)
                 WHEN aimed_departure IS NOT NULL AND expected_departure IS NOT NULL
                 THEN trunc((epoch_us(expected_departure) - epoch_us(aimed_departure)) / 1000000.0)
            END AS INTEGER) AS delay_seconds
FROM ({SQL_STOP_VISITS_RAW}) r"""


# --------------------------------------------------------------------------- air
def _station_lat(k):
    return F.lit(47.9) + (k * 7919 % 2300).cast("double") / F.lit(1000.0)


def _station_lon(k):
    return F.lit(1.4) + (k * 104729 % 2300).cast("double") / F.lit(1000.0)


def air_raw(spark: SparkSession, sf_dir: str, with_event_id: bool = False) -> DataFrame:
    """Air measurements: one per event, station = user."""
    e = _events(spark, sf_dir)
    u, v, et = F.col("user_id"), F.col("value"), F.col("event_type")
    return e.select(*(["event_id"] if with_event_id else []),
        F.concat(F.lit("@"), u.cast("string")).alias("station_id"),
        F.concat(_pick(u % 10, PLACE_NAMES), F.lit(" "), u.cast("string")).alias("station_name"),
        _station_lat(u).alias("latitude"), _station_lon(u).alias("longitude"),
        F.when(et != "click", F.floor(v * 1.5).cast("int")).alias("aqi"),
        F.when(et != "error", v).alias("pm25"),
        (v * 1.3).alias("pm10"),
        F.when(et != "view", v * 0.8).alias("no2"),
        (v * 0.5).alias("o3"),
        F.lit(None).cast("double").alias("so2"), F.lit(None).cast("double").alias("co"),
        (v % 30.0 - 2.0).alias("temperature_c"),
        (F.col("event_id") % 50 + 40).cast("double").alias("humidity_pct"),
        (F.col("event_id") % 30 + 1000).cast("double").alias("pressure_hpa"),
        F.lit(None).cast("double").alias("wind_speed_ms"),
        F.col("ts").alias("measured_at"), F.col("ts").alias("recorded_at"),
        F.when(u % 3 != 0, F.lit("Airparif")).alias("attribution"),
        F.lit("aqicn").alias("source"),
    )


SQL_AIR = f"""
SELECT '@' || CAST(user_id AS VARCHAR) AS station_id,
       {_sql_pick('user_id % 10', PLACE_NAMES)} || ' ' || CAST(user_id AS VARCHAR) AS station_name,
       47.9 + CAST(user_id * 7919 % 2300 AS DOUBLE) / 1000.0 AS latitude,
       1.4 + CAST(user_id * 104729 % 2300 AS DOUBLE) / 1000.0 AS longitude,
       CASE WHEN event_type <> 'click' THEN CAST(floor(value * 1.5) AS INTEGER) END AS aqi,
       CASE WHEN event_type <> 'error' THEN value END AS pm25,
       value * 1.3 AS pm10,
       CASE WHEN event_type <> 'view' THEN value * 0.8 END AS no2,
       value * 0.5 AS o3, CAST(NULL AS DOUBLE) AS so2, CAST(NULL AS DOUBLE) AS co,
       value % 30.0 - 2.0 AS temperature_c,
       CAST(event_id % 50 + 40 AS DOUBLE) AS humidity_pct,
       CAST(event_id % 30 + 1000 AS DOUBLE) AS pressure_hpa,
       CAST(NULL AS DOUBLE) AS wind_speed_ms,
       ts AS measured_at, ts AS recorded_at,
       CASE WHEN user_id % 3 <> 0 THEN 'Airparif' END AS attribution, 'aqicn' AS source
FROM events"""


# --------------------------------------------------------------------------- weather
def weather_raw(spark: SparkSession, sf_dir: str, with_event_id: bool = False) -> DataFrame:
    """Weather observations: one per event, point = user div 2."""
    e = _events(spark, sf_dir)
    k, v, et = F.expr("user_id div 2"), F.col("value"), F.col("event_type")
    precip = F.when(et == "error", F.lit(None).cast("double")).when(et == "purchase", v % 12.0).otherwise(F.lit(0.0))
    return e.select(*(["event_id"] if with_event_id else []),
        F.concat(F.lit("P"), k.cast("string")).alias("point_id"),
        F.concat(_pick(k % 10, PLACE_NAMES), F.lit(" météo "), k.cast("string")).alias("point_name"),
        (F.lit(47.9) + (k * 3571 % 2300).cast("double") / F.lit(1000.0)).alias("latitude"),
        (F.lit(1.4) + (k * 6007 % 2300).cast("double") / F.lit(1000.0)).alias("longitude"),
        F.lit(None).cast("double").alias("elevation_m"),
        (v % 40.0 - 5.0).alias("temperature_c"),
        (v % 40.0 - 7.0).alias("apparent_temperature_c"),
        (F.col("event_id") % 60 + 30).cast("double").alias("humidity_pct"),
        precip.alias("precipitation_mm"), precip.alias("rain_mm"), F.lit(0.0).alias("snowfall_cm"),
        (v % 20.0).alias("wind_speed_ms"),
        F.when(et != "signup", v % 11.0).alias("uv_index"),
        (F.hour("ts").between(7, 19)).alias("is_day"),
        (F.col("event_id") % 4).cast("short").alias("weather_code"),
        F.col("ts").alias("observed_at"), F.col("ts").alias("recorded_at"),
        F.lit("open-meteo").alias("source"),
    )


SQL_WEATHER = f"""
SELECT 'P' || CAST(user_id // 2 AS VARCHAR) AS point_id,
       {_sql_pick('(user_id // 2) % 10', PLACE_NAMES)} || ' météo ' || CAST(user_id // 2 AS VARCHAR) AS point_name,
       47.9 + CAST((user_id // 2) * 3571 % 2300 AS DOUBLE) / 1000.0 AS latitude,
       1.4 + CAST((user_id // 2) * 6007 % 2300 AS DOUBLE) / 1000.0 AS longitude,
       CAST(NULL AS DOUBLE) AS elevation_m,
       value % 40.0 - 5.0 AS temperature_c, value % 40.0 - 7.0 AS apparent_temperature_c,
       CAST(event_id % 60 + 30 AS DOUBLE) AS humidity_pct,
       CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN value % 12.0 ELSE 0.0 END
            AS precipitation_mm,
       CASE WHEN event_type = 'error' THEN NULL WHEN event_type = 'purchase' THEN value % 12.0 ELSE 0.0 END AS rain_mm,
       0.0 AS snowfall_cm,
       value % 20.0 AS wind_speed_ms,
       CASE WHEN event_type <> 'signup' THEN value % 11.0 END AS uv_index,
       hour(ts) BETWEEN 7 AND 19 AS is_day,
       CAST(event_id % 4 AS SMALLINT) AS weather_code,
       ts AS observed_at, ts AS recorded_at, 'open-meteo' AS source
FROM events"""


# --------------------------------------------------------------------------- line dimension
def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    mode = None
    for k, v in LINE_MODE_BY_PART_TYPE.items():
        mode = F.when(F.col("p_type") == k, F.lit(v)) if mode is None else mode.when(F.col("p_type") == k, F.lit(v))
    return p.select(
        F.concat(F.lit("STIF:Line::C"), F.col("p_partkey").cast("string"), F.lit(":")).alias("line_id"),
        F.col("p_brand").alias("short_name"), F.col("p_name").alias("long_name"),
        mode.alias("transport_mode"), F.lower("p_type").alias("transport_submode"),
        F.concat(F.lit("Réseau "), (F.col("p_size") % 5).cast("string")).alias("network_name"),
        _pick(F.col("p_partkey") % 3, ["RATP", "SNCF", None]).alias("operator_name"),
        F.lit(None).cast("string").alias("color_web_hex"), F.lit(None).cast("string").alias("text_color_hex"),
        F.lit("active").alias("status"), F.lit(None).cast("string").alias("accessibility"),
        F.lit("2024-01-15 00:00:00").cast("timestamp").alias("last_refreshed_at"),
    )


SQL_LINES = f"""
SELECT 'STIF:Line::C' || CAST(p_partkey AS VARCHAR) || ':' AS line_id,
       p_brand AS short_name, p_name AS long_name,
       CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LINE_MODE_BY_PART_TYPE.items())} END AS transport_mode,
       lower(p_type) AS transport_submode,
       'Réseau ' || CAST(p_size % 5 AS VARCHAR) AS network_name,
       {_sql_pick('p_partkey % 3', ['RATP', 'SNCF', None])} AS operator_name,
       CAST(NULL AS VARCHAR) AS color_web_hex, CAST(NULL AS VARCHAR) AS text_color_hex,
       'active' AS status, CAST(NULL AS VARCHAR) AS accessibility,
       TIMESTAMP '2024-01-15 00:00:00' AS last_refreshed_at
FROM part"""


# --------------------------------------------------------------------------- journeys
def waypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per waypoint: a customer's orders are its journey's points."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    k = F.col("o_orderkey")
    return o.select(
        F.concat(F.lit("J"), F.col("o_custkey").cast("string")).alias("journey_id"),
        k.alias("pos"),
        (F.lit(48.0) + (k * 6007 % 2000).cast("double") / F.lit(1000.0)).alias("latitude"),
        (F.lit(1.5) + (k * 7001 % 2000).cast("double") / F.lit(1000.0)).alias("longitude"),
    )


SQL_WAYPOINTS = """
SELECT 'J' || CAST(o_custkey AS VARCHAR) AS journey_id, o_orderkey AS pos,
       48.0 + CAST(o_orderkey * 6007 % 2000 AS DOUBLE) / 1000.0 AS latitude,
       1.5 + CAST(o_orderkey * 7001 % 2000 AS DOUBLE) / 1000.0 AS longitude
FROM orders"""


def journeys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Journey requests: id, label, the comparison they belong to and their position in it."""
    c = table(spark, sf_dir, "customer")
    return c.select(
        F.concat(F.lit("J"), F.col("c_custkey").cast("string")).alias("journey_id"),
        F.col("c_name").alias("journey_label"),
        F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("comparison_id"),
        F.col("c_custkey").alias("input_pos"),
    )


SQL_JOURNEYS = """
SELECT 'J' || CAST(c_custkey AS VARCHAR) AS journey_id, c_name AS journey_label,
       'N' || CAST(c_nationkey AS VARCHAR) AS comparison_id, c_custkey AS input_pos
FROM customer"""


def with_views(sql: str, **views: str) -> str:
    """Prefix a query with CTEs for the named adapter views."""
    if not views:
        return sql
    ctes = ",\n".join(f"{name} AS ({body})" for name, body in views.items())
    return f"WITH {ctes}\n{sql}"


def with_event_id(sql: str) -> str:
    """The same view with the source event id as first column."""
    return sql.replace("SELECT ", "SELECT event_id, ", 1)



# --------------------------------------------------------------------------- large stop visits
# Order lines as stop visits: the line is the part, the stop the supplier,
# planned arrival the order date, actual arrival the ship date.
AS_OF_LARGE = "2000-01-01 00:00:00"


def stop_visits_large_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
                                                  F.col("l_shipdate").cast("timestamp").alias("ship"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                              F.col("o_orderdate").cast("timestamp").alias("od"))
    j = li.join(o, "l_orderkey")
    return j.select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("stop_id"),
        F.concat(F.lit("STIF:Line::C"), F.col("l_partkey").cast("string"), F.lit(":")).alias("line_id"),
        F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias(
            "vehicle_journey_id"),
        F.lit("unknown").alias("transport_mode"),
        F.col("od").alias("aimed_arrival"), F.col("ship").alias("expected_arrival"),
        F.col("od").alias("recorded_at"), F.lit("prim").alias("source"))


SQL_STOP_VISITS_LARGE = """
SELECT 'S' || CAST(l.l_suppkey AS VARCHAR) AS stop_id, 'STIF:Line::C' || CAST(l.l_partkey AS VARCHAR) || ':' AS line_id,
       CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS vehicle_journey_id,
       'unknown' AS transport_mode, o.o_orderdate AS aimed_arrival, l.l_shipdate AS expected_arrival,
       o.o_orderdate AS recorded_at, 'prim' AS source
FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey"""

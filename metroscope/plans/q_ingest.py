"""Registered queries: feed scans, loads, upserts, clean-up, retention."""

from __future__ import annotations

from pyspark.sql import functions as F

from metroscope.functions import mobility as mb
from metroscope.operators import bucketed, delays, facts, rollups, sinks, topn
from metroscope.operators.common import stored_copy
from metroscope.plans import adapters as A
from metroscope.plans import adapters_bronze as B
from metroscope.plans.queries import AS_OF_SQL, r6, register, sql_r6, views
from metroscope.sources import air as s_air
from metroscope.sources import bronze as s_bronze
from metroscope.sources import journeys as s_journeys
from metroscope.sources import lines as s_lines
from metroscope.sources import stations as s_stations
from metroscope.sources import stop_visits as s_visits
from metroscope.sources import weather as s_weather

AS_OF = A.AS_OF
VISIT_COLS = ["stop_id", "line_id", "vehicle_journey_id", "line_name", "operator", "direction", "transport_mode",
              "aimed_arrival", "expected_arrival", "aimed_departure", "expected_departure", "arrival_status",
              "departure_status", "delay_seconds", "recorded_at", "source"]
RAW_E = A.with_event_id(A.SQL_STOP_VISITS_RAW)
DELAY_SQL = """CAST(CASE WHEN aimed_arrival IS NOT NULL AND expected_arrival IS NOT NULL
                 THEN trunc((epoch_us(expected_arrival) - epoch_us(aimed_arrival)) / 1000000.0)
                 WHEN aimed_departure IS NOT NULL AND expected_departure IS NOT NULL
                 THEN trunc((epoch_us(expected_departure) - epoch_us(aimed_departure)) / 1000000.0) END AS INTEGER)"""
MODE_SQL = """CASE WHEN transport_mode IN ('metro', 'rer', 'tram', 'bus') THEN transport_mode
                   WHEN upper(coalesce(operator, '')) LIKE '%SNCF%' THEN 'train' ELSE 'unknown' END"""


def _scanned(spark, d, journey_ref="reference"):
    bronze = B.stop_monitoring(spark, d)
    return s_visits.scan_stop_visits(bronze, keep=("event_id",), journey_ref=journey_ref)


def _silver(spark, d, journey_ref="reference"):
    p = _scanned(spark, d, journey_ref)
    return facts.stop_visit_rows(p)


def _scan_sql(vj: str) -> str:
    return A.with_views(f"""
SELECT stop_id, line_id, {vj} AS vehicle_journey_id,
       CASE WHEN event_id % 4 <> 1 THEN line_name ELSE regexp_extract(line_id, '([^:]+):*$', 1) END AS line_name,
       operator, direction, {MODE_SQL} AS transport_mode,
       aimed_arrival, expected_arrival, aimed_departure, expected_departure, arrival_status, departure_status,
       {DELAY_SQL} AS delay_seconds, recorded_at, source
FROM raw WHERE event_id % 89 <> 0""", raw=RAW_E)


@register("scan_stop_visits", _scan_sql("CAST(NULL AS VARCHAR)"))
def q_scan_stop_visits(spark, d):
    """Stop-monitoring JSON -> silver stop visits (journey ref read as the reference does)."""
    return _silver(spark, d).select(*VISIT_COLS)


@register("scan_stop_visits_dated", _scan_sql("vehicle_journey_id"))
def q_scan_stop_visits_dated(spark, d):
    """Same scan, journey id from the dated journey reference."""
    return _silver(spark, d, "dated").select(*VISIT_COLS)


@register("valid_rows", A.with_views("SELECT event_id FROM raw WHERE event_id % 89 = 0", raw=RAW_E))
def q_valid_rows(spark, d):
    """Visits rejected by the mandatory-field filter (no stop or no line)."""
    _, rejects = s_visits.scan_stop_visits(B.stop_monitoring(spark, d), keep=("event_id",), with_rejects=True)
    return rejects.select("event_id")


def _board_order():
    return [F.col("best_time").asc_nulls_last(), F.col("event_id")]


@register("stop_board", A.with_views(f"""
SELECT event_id, stop_id, coalesce(expected_arrival, expected_departure, aimed_arrival, aimed_departure) AS best_time
FROM raw WHERE event_id % 89 <> 0""", raw=RAW_E))
def q_stop_board(spark, d):
    """Stop board: visits by best time (NULL last), stable on input order."""
    board = _scanned(spark, d).select("event_id", "stop_id", mb.best_time().alias("best_time"))
    # a global sort reads its input twice, first for the ranges: the documents are scanned once
    return stored_copy(board, "stop-board").orderBy(*_board_order())


@register("stop_board_topn", A.with_views(f"""
SELECT stop_id, event_id, best_time, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY stop_id ORDER BY best_time ASC NULLS LAST, event_id) AS rank FROM (
    SELECT event_id, stop_id, coalesce(expected_arrival, expected_departure, aimed_arrival, aimed_departure) AS best_time
    FROM raw WHERE event_id % 89 <> 0)) WHERE rank <= 15""", raw=RAW_E))
def q_stop_board_topn(spark, d):
    """First 15 visits of every stop's board (distributed top-N)."""
    p = _scanned(spark, d).select("event_id", "stop_id", mb.best_time().alias("best_time"))
    t = topn.top_n_per_key(p, ["stop_id"], _board_order(), 15)
    return t.select("stop_id", "event_id", "best_time", F.col("rank").cast("int").alias("rank"))


@register("project_sink", A.with_views("SELECT " + ", ".join(VISIT_COLS) + " FROM stop_visits",
                                        **views("stop_visits")))
def q_project_sink(spark, d):
    """Parsed visits -> sink columns (stored delay, defaults)."""
    return facts.stop_visit_rows(A.stop_visits_raw(spark, d)).select(*VISIT_COLS)


ARRIVAL = ["event_id", "delivery_pos", "visit_pos"]  # fetch, delivery and visit position


def _load_twice(spark, rows, keys, order, key_exprs=None, range_col=None):
    """The stored table after loading the same batch twice (the second load must add nothing)."""
    path = sinks.scratch_path(spark, "load")
    rows = stored_copy(rows, "load-batch")  # the feed is scanned once, both loads read its rows
    for _ in range(2):
        sinks.insert_if_absent(rows, path, keys, order, key_exprs, range_col=range_col)
    return spark.read.parquet(path)


def _first_rows(cols: str, table: str, keys: str, where: str = "true") -> str:
    return (f"SELECT {cols} FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY event_id) AS rn "
            f"FROM {table} WHERE {where}) WHERE rn = 1")


@register("load_visits", A.with_views(_first_rows(
    f"stop_id, line_id, recorded_at, direction, operator, aimed_arrival, expected_departure, {DELAY_SQL} AS delay_seconds",
    "raw", "stop_id, line_id, recorded_at", "event_id % 89 <> 0"), raw=RAW_E))
def q_load_visits(spark, d):
    """Insert-if-absent, twice: the stored rows are the first arrivals of every load key."""
    rows = facts.stop_visit_rows(_scanned(spark, d), keep=ARRIVAL)
    out = _load_twice(spark, rows, ["stop_id", "line_id", "vehicle_journey_key", "recorded_at"], ARRIVAL,
                      {"vehicle_journey_key": mb.vehicle_journey_key()}, range_col="recorded_at")
    return out.select("stop_id", "line_id", "recorded_at", "direction", "operator", "aimed_arrival", "expected_departure",
                      "delay_seconds")


@register("load_visits_bucketed", A.with_views(_first_rows(
    f"stop_id, line_id, recorded_at, direction, operator, aimed_arrival, expected_departure, {DELAY_SQL} AS delay_seconds",
    "raw", "stop_id, line_id, recorded_at", "event_id % 89 <> 0"), raw=RAW_E))
def q_load_visits_bucketed(spark, d):
    """The same load, twice, into a table bucketed by the load key that is never shuffled."""
    rows = facts.stop_visit_rows(_scanned(spark, d), keep=ARRIVAL).withColumn("vehicle_journey_key", mb.vehicle_journey_key())
    cols = ["stop_id", "line_id", "vehicle_journey_key", "recorded_at", "direction", "operator", "aimed_arrival", "expected_departure",
            "delay_seconds"]
    parsed = stored_copy(rows.select(*cols, *ARRIVAL), "load-batch")  # the feed is scanned once, both loads read its rows
    target = bucketed.BucketedTarget(spark, sinks.scratch_path(spark, "bucketed"), parsed.select(*cols).schema, cols[:4], "recorded_at",
                                     int(spark.conf.get("spark.sql.shuffle.partitions")))
    for _ in range(2):
        target.insert(parsed, ARRIVAL)
    return target.rows().drop("vehicle_journey_key")


SQL_AIR_E = A.with_event_id(A.SQL_AIR)


@register("scan_air", A.with_views("""
SELECT station_id, station_name, latitude, longitude, aqi, pm25, pm10, no2, o3, so2, co, temperature_c, humidity_pct,
       pressure_hpa, wind_speed_ms, measured_at, attribution, source
FROM air WHERE event_id % 50 <> 0 AND event_id % 41 <> 0""", air=SQL_AIR_E))
def q_scan_air(spark, d):
    """Station feed JSON -> air measurements (status / geo / time / id guards)."""
    a = s_air.scan_air(B.air_feed(spark, d), keep=("event_id",))
    return a.select("station_id", "station_name", "latitude", "longitude", "aqi", "pm25", "pm10", "no2", "o3", "so2",
                    "co", "temperature_c", "humidity_pct", "pressure_hpa", "wind_speed_ms", "measured_at",
                    "attribution", "source")


@register("load_air", A.with_views(_first_rows(
    "station_id, measured_at, station_name, aqi, pm25, no2, humidity_pct", "air", "station_id, measured_at",
    "event_id % 50 <> 0 AND event_id % 41 <> 0"), air=SQL_AIR_E))
def q_load_air(spark, d):
    """Insert-if-absent, twice: the first measurement that arrived for every station and time."""
    rows = facts.air_rows(s_air.scan_air(B.air_feed(spark, d), keep=("event_id",)), keep=("event_id",))
    out = _load_twice(spark, rows, ["station_id", "measured_at"], ["event_id"], range_col="measured_at")
    return out.select("station_id", "measured_at", "station_name", "aqi", "pm25", "no2", "humidity_pct")


SQL_WX_E = A.with_event_id(A.SQL_WEATHER)
WX_COLS = ["point_id", "point_name", "latitude", "longitude", "temperature_c", "apparent_temperature_c", "humidity_pct",
           "precipitation_mm", "rain_mm", "snowfall_cm", "wind_speed_ms", "is_day", "weather_code", "uv_index",
           "observed_at"]


@register("scan_weather", A.with_views(f"""
SELECT event_id AS fetch_id, {", ".join(c if c != "uv_index" else "CASE WHEN event_id % 7 <> 0 THEN uv_index END AS uv_index" for c in WX_COLS)},
       CAST(NULL AS DOUBLE) AS pm25, CAST(NULL AS DOUBLE) AS cloud_cover_pct
FROM weather""", weather=SQL_WX_E))
def q_scan_weather(spark, d):
    """Forecast JSON LEFT JOIN air-quality JSON -> weather observations."""
    fc, aq = B.weather_feeds(spark, d)
    w = s_weather.scan_weather(fc, aq)
    return w.select("fetch_id", *WX_COLS, "pm25", "cloud_cover_pct")


@register("load_weather", A.with_views(_first_rows(
    "point_id, observed_at, point_name, temperature_c, precipitation_mm, weather_code", "weather", "point_id, observed_at"),
    weather=SQL_WX_E))
def q_load_weather(spark, d):
    """Insert-if-absent, twice: the first observation that arrived for every point and time."""
    fc, aq = B.weather_feeds(spark, d)
    rows = facts.weather_rows(s_weather.scan_weather(fc, aq), keep=("fetch_id",))
    out = _load_twice(spark, rows, ["point_id", "observed_at"], ["fetch_id"], range_col="observed_at")
    return out.select("point_id", "observed_at", "point_name", "temperature_c", "precipitation_mm", "weather_code")


LINE_COLS = ["line_id", "short_name", "long_name", "transport_mode", "transport_submode", "network_name",
             "operator_name", "color_web_hex", "text_color_hex", "status", "accessibility"]
SQL_LINE_ROWS = """
SELECT 'STIF:Line::C' || CAST(p_partkey AS VARCHAR) || ':' AS line_id, p_brand AS short_name, p_name AS long_name,
       lower(p_type) AS transport_mode, CAST(NULL AS VARCHAR) AS transport_submode, CAST(NULL AS VARCHAR) AS network_name,
       'RATP' AS operator_name, '#' || upper(substr(md5(p_name), 1, 6)) AS color_web_hex,
       CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE '#FFFFFF' END AS text_color_hex, 'active' AS status,
       CAST(NULL AS VARCHAR) AS accessibility
FROM part WHERE p_partkey % 97 <> 0
UNION ALL
SELECT 'STIF:Line::C' || CAST(p_partkey AS VARCHAR) || ':', 'DUP', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL
FROM part WHERE p_partkey % 97 = 0 AND p_partkey % 50 = 0"""


@register("scan_lines", A.with_views("SELECT * FROM line_rows", line_rows=SQL_LINE_ROWS))
def q_scan_lines(spark, d):
    """Line reference pages -> dimension rows (id build, colours, first wins)."""
    return s_lines.scan_lines(B.line_pages(spark, d)).select(*LINE_COLS)


@register("upsert_lines", A.with_views(f"""
SELECT 'STIF:Line::C' || CAST(k AS VARCHAR) || ':' AS line_id,
       CASE WHEN dup THEN 'DUP' ELSE p_brand END AS short_name, CASE WHEN dup THEN NULL ELSE p_name END AS long_name,
       CASE WHEN dup THEN NULL ELSE lower(p_type) END AS transport_mode, CASE WHEN dup THEN NULL ELSE 'active' END AS status,
       CASE WHEN again THEN {AS_OF_SQL} ELSE TIMESTAMP '2024-01-01 00:00:00' END AS last_refreshed_at
FROM (
  SELECT *, k % 50 = 0 AND (page % 2 = 1 OR k % 97 = 0) AS dup,
         (page % 2 = 0 AND k % 97 <> 0) OR (page % 2 = 1 AND k % 50 = 0) AS again
  FROM (SELECT *, p_partkey AS k, p_partkey // 100 AS page FROM part) WHERE k % 97 <> 0 OR k % 50 = 0)"""))
def q_upsert_lines(spark, d):
    """Upsert every page, then the even pages again: rows of odd pages keep their
    first stamp, repeated line ids take their last record of each batch."""
    records = s_lines.scan_lines(B.line_pages(spark, d), dedupe=False).select("page_offset", "rec_pos", *LINE_COLS)
    order = ["page_offset", "rec_pos"]
    v1 = sinks.upsert_dimension(records, None, sinks.scratch_path(spark, "lines"), "line_id", order, as_of="2024-01-01 00:00:00")
    again = records.filter(F.col("page_offset") % 200 == 0)
    v2 = sinks.upsert_dimension(again, v1, sinks.scratch_path(spark, "lines"), "line_id", order, as_of=AS_OF)
    return v2.select("line_id", "short_name", "long_name", "transport_mode", "status", "last_refreshed_at")


@register("discover_stations", A.with_views("""
SELECT '@' || CAST(s_suppkey AS VARCHAR) AS uid, s_name AS name, lat AS latitude, lon AS longitude,
       CAST(CAST(trunc(abs(s_acctbal) % 300) AS INTEGER) AS VARCHAR) AS aqi,
       CASE WHEN s_suppkey % 4 <> 0 THEN 'Airparif' ELSE '?' END AS attribution
FROM (SELECT *, 48.3 + CAST(s_suppkey * 7919 % 1100 AS DOUBLE) / 1000.0 AS lat,
             1.6 + CAST(s_suppkey * 104729 % 1700 AS DOUBLE) / 1000.0 AS lon FROM supplier)
WHERE lat BETWEEN 48.5 AND 49.2 AND lon BETWEEN 1.8 AND 3.1 AND s_suppkey % 13 <> 0 AND s_acctbal >= 0"""))
def q_discover_stations(spark, d):
    listing, feeds = B.station_listing(spark, d)
    return s_stations.discover_stations(listing, feeds)


SQL_SPEC_POINTS = """
SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS journey_id, 0 AS pos,
       48.0 + CAST(o_orderkey * 6007 % 2000 AS DOUBLE) / 1000.0 AS latitude,
       1.5 + CAST(o_orderkey * 7001 % 2000 AS DOUBLE) / 1000.0 AS longitude
FROM orders WHERE o_orderkey % 53 <> 0 AND o_orderkey % 59 <> 0
UNION ALL
SELECT 'O' || CAST(o_orderkey AS VARCHAR), 1, 48.0 + CAST(o_orderkey * 3001 % 2000 AS DOUBLE) / 1000.0,
       1.5 + CAST(o_orderkey * 9001 % 2000 AS DOUBLE) / 1000.0
FROM orders WHERE o_orderkey % 53 <> 0 AND o_orderkey % 59 <> 0"""


@register("journey_spec", A.with_views("SELECT * FROM pts", pts=SQL_SPEC_POINTS))
def q_journey_spec(spark, d):
    """Journey spec text -> one row per waypoint (bad specs rejected)."""
    _, wps, _ = s_journeys.parse_journey_specs(B.journey_specs(spark, d))
    return wps.select("journey_id", F.col("pos").cast("int").alias("pos"), "latitude", "longitude")


@register("journey_spec_rejects", """
SELECT reason, count(*) AS n FROM (
  SELECT CASE WHEN o_orderkey % 53 = 0 THEN 'needs id:label and two waypoints' ELSE 'point is not lat,lon' END AS reason
  FROM orders WHERE o_orderkey % 53 = 0 OR o_orderkey % 59 = 0) GROUP BY reason""")
def q_journey_spec_rejects(spark, d):
    _, _, rej = s_journeys.parse_journey_specs(B.journey_specs(spark, d))
    return rej.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("journey_slug", A.with_views("SELECT journey_id, lower(replace(journey_label, ' ', '-')) AS slug FROM journeys",
                                       **views("journeys")))
def q_journey_slug(spark, d):
    return A.journeys(spark, d).select("journey_id", mb.journey_slug("journey_label").alias("slug"))


@register("bronze_write", A.with_views("""
SELECT 'prim' AS source, CAST(CAST(recorded_at AS DATE) AS VARCHAR) AS ingest_date, count(*) AS n_files
FROM stop_visits GROUP BY 2""", **views("stop_visits")))
def q_bronze_write(spark, d):
    """Archive raw responses partitioned by source and date; read back counts."""
    bronze = B.stop_monitoring(spark, d, keep=("recorded_at",))
    bronze = bronze.select("raw", F.lit("prim").alias("source"),
                           F.date_format("recorded_at", "yyyy-MM-dd").alias("ingest_date"))
    path = sinks.scratch_path(spark, "bronze")
    s_bronze.write_bronze(bronze, path)
    return s_bronze.read_archive(spark, path).groupBy("source", "ingest_date").agg(F.count(F.lit(1)).alias("n_files"))


@register("bronze_roundtrip", _scan_sql("CAST(NULL AS VARCHAR)"))
def q_bronze_roundtrip(spark, d):
    """Archive the responses, read the archive back and scan it: the rows of the direct scan."""
    bronze = B.stop_monitoring(spark, d).select("event_id", "raw", F.lit("prim").alias("source"),
                                                F.lit(str(AS_OF)[:10]).alias("ingest_date"))
    path = sinks.scratch_path(spark, "archive")
    # documents carry line breaks, as indented responses do
    indented = bronze.withColumn("raw", F.regexp_replace("raw", "^\\{", "{\n  "))
    s_bronze.write_bronze(indented, path)
    back = s_bronze.read_archive(spark, path)
    return facts.stop_visit_rows(s_visits.scan_stop_visits(back, keep=("ingest_date",))).select(*VISIT_COLS)


@register("archive_names", A.with_views("""
SELECT stop_id, recorded_at, 'prim_' || trim(replace(stop_id, ':', '_'), '_') || '_' || strftime(recorded_at, '%Y%m%d_%H%M%S') || '.json' AS file_name
FROM stop_visits""", **views("stop_visits")))
def q_archive_names(spark, d):
    v = A.stop_visits_raw(spark, d)
    return v.select("stop_id", "recorded_at", s_bronze.archive_name(F.col("stop_id"), F.col("recorded_at")).alias("file_name"))


@register("cleanup_bbox", A.with_views("""
SELECT count(*) AS before, count(*) FILTER (WHERE NOT coalesce(latitude BETWEEN 48.0 AND 50.0
       AND longitude BETWEEN 1.5 AND 3.5, false)) AS removed,
       count(*) FILTER (WHERE coalesce(latitude BETWEEN 48.0 AND 50.0 AND longitude BETWEEN 1.5 AND 3.5, false)) AS after,
       (SELECT count(*) FROM air WHERE coalesce(latitude BETWEEN 48.0 AND 50.0 AND longitude BETWEEN 1.5 AND 3.5, false))
         AS stored
FROM air""", **views("air")))
def q_cleanup_bbox(spark, d):
    """Delete measurements outside the region box (rewrite to a new path)."""
    path = sinks.scratch_path(spark, "air-clean")
    c = sinks.delete_outside_box(A.air_raw(spark, d), path)
    stored = spark.read.parquet(path).count()
    return spark.createDataFrame([(c["before"], c["removed"], c["after"], stored)],
                                 "before long, removed long, after long, stored long")


def _retention_sql(days, where):
    return f"""
SELECT line_id, date_trunc('hour', recorded_at) AS hour, count(*) AS n_rows,
       {sql_r6('avg(delay_seconds)')} AS avg_delay_seconds, min(delay_seconds) AS min_delay_seconds,
       max(delay_seconds) AS max_delay_seconds, CASE WHEN recorded_at < {AS_OF_SQL} - INTERVAL {days} DAY THEN 'cold' ELSE 'hot' END AS tier
FROM stop_visits WHERE {where} GROUP BY line_id, hour, tier"""


@register("retention_rollup", A.with_views(_retention_sql(7, f"recorded_at < {AS_OF_SQL} - INTERVAL 7 DAY"), **views("stop_visits")))
def q_retention_rollup(spark, d):
    """Rows older than a week rolled up per line and hour."""
    from metroscope.plans.queries import visits
    r = sinks.retention_rollup(visits(spark, d), "recorded_at", ["line_id"], ["delay_seconds"], AS_OF, days=7)
    return r.select("line_id", "hour", "n_rows", r6("avg_delay_seconds").alias("avg_delay_seconds"),
                    "min_delay_seconds", "max_delay_seconds", F.lit("cold").alias("tier"))


@register("retention_union", A.with_views(_retention_sql(90, "true"), **views("stop_visits")))
def q_retention_union(spark, d):
    """Hourly rows over everything: 90 days from raw rows, older ones rolled up."""
    from metroscope.plans.queries import visits
    r = sinks.retention_union(visits(spark, d), "recorded_at", ["line_id"], ["delay_seconds"], AS_OF)
    return r.withColumn("avg_delay_seconds", r6("avg_delay_seconds"))


def _rollup(spark, d):
    """Roll-up fed by three batches; the second and third bring late rows of hours already stored."""
    from metroscope.plans.queries import visits
    v = visits(spark, d)
    r = rollups.HourlyRollup(spark, sinks.scratch_path(spark, "rollup"), "recorded_at", ["line_id"], ["delay_seconds"], distinct="line_id")
    for i in range(3):
        r.add(v.filter(F.pmod(F.xxhash64("line_id", "recorded_at"), F.lit(3)) == i), i)
    return r


@register("rollup_hours", A.with_views(f"""
SELECT line_id, date_trunc('hour', recorded_at) AS hour, count(*) AS n_rows, {sql_r6('avg(delay_seconds)')} AS avg_delay_seconds,
       min(delay_seconds) AS min_delay_seconds, max(delay_seconds) AS max_delay_seconds FROM stop_visits GROUP BY ALL""", **views("stop_visits")))
def q_rollup_hours(spark, d):
    """Hourly roll-up after late rows, merged from stored partials."""
    return _rollup(spark, d).hours().withColumn("avg_delay_seconds", r6("avg_delay_seconds"))


@register("rollup_totals", A.with_views(f"""
SELECT count(*) AS n_rows, count(DISTINCT line_id) AS n_distinct, count(delay_seconds) AS n_delay_seconds, {sql_r6('avg(delay_seconds)')} AS avg_delay_seconds
FROM stop_visits WHERE recorded_at >= {AS_OF_SQL} - INTERVAL 24 HOUR""", **views("stop_visits")))
def q_rollup_totals(spark, d):
    """Rows, active lines and mean delay of the last 24 h from stored partials and bitmaps."""
    t = _rollup(spark, d).totals(F.lit(AS_OF).cast("timestamp") - F.expr("INTERVAL 24 HOURS"))
    return t.withColumn("avg_delay_seconds", r6("avg_delay_seconds"))


@register("unknown_line_report", A.with_views("""
SELECT line_id, count(*) AS visits FROM stop_visits v
WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.line_id = v.line_id) GROUP BY line_id""",
                                              **views("stop_visits", "lines")))
def q_unknown_line_report(spark, d):
    """Fact line ids missing from the dimension, with their visit counts."""
    from metroscope.plans.queries import visits
    u = delays.unknown_lines(visits(spark, d), A.lines(spark, d))
    return u.groupBy("line_id").agg(F.count(F.lit(1)).alias("visits"))

"""Registered queries: delay analytics, dashboard reports, lookups, filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from metroscope.functions import formats as fm
from metroscope.functions import mobility as mb
from metroscope.functions.geo import in_bbox
from metroscope.operators import dashboard, delays, snapshots, substrings
from metroscope.plans import adapters as A
from metroscope.plans.queries import AS_OF_SQL, r6, register, sql_r6, views, visits

AS_OF = A.AS_OF
V = views("stop_visits", "air", "weather", "lines")
ARR = "(epoch_us(expected_arrival) - epoch_us(aimed_arrival)) / 1000000.0"


def _recent(hours: int) -> str:
    return (f"SELECT *, {ARR} AS delay_sec FROM stop_visits WHERE recorded_at >= {AS_OF_SQL} - INTERVAL {hours} HOUR "
            f"AND aimed_arrival IS NOT NULL AND expected_arrival IS NOT NULL")


def q(sql: str, **extra) -> str:
    vv = dict(V)
    vv.update(extra)
    return A.with_views(sql, **vv)


@register("global_stats", q("""
SELECT (SELECT count(*) FROM stop_visits) AS stop_visits_count, (SELECT count(*) FROM air) AS air_count,
       (SELECT count(*) FROM weather) AS weather_count, (SELECT count(*) FROM lines) AS lines_count,
       (SELECT max(recorded_at) FROM stop_visits) AS last_stop_visit, (SELECT max(measured_at) FROM air) AS last_air,
       (SELECT max(observed_at) FROM weather) AS last_weather"""))
def q_global_stats(spark, d):
    return delays.global_stats(visits(spark, d), A.air_raw(spark, d), A.weather_raw(spark, d), A.lines(spark, d))


@register("ingestion_history", q(f"""
SELECT date_trunc('hour', recorded_at) AS hour, 'PRIM IDFM' AS source, count(*) AS count FROM stop_visits
WHERE recorded_at >= {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY 1
UNION ALL
SELECT date_trunc('hour', measured_at), 'AQICN', count(*) FROM air WHERE measured_at >= {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY 1
UNION ALL
SELECT date_trunc('hour', observed_at), 'Open-Meteo', count(*) FROM weather
WHERE observed_at >= {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY 1"""))
def q_ingestion_history(spark, d):
    return delays.ingestion_history(visits(spark, d), A.air_raw(spark, d), A.weather_raw(spark, d), AS_OF)


@register("traffic_kpis", q(f"""
SELECT count(*) AS total_visits, count(DISTINCT line_id) AS active_lines,
       {sql_r6('coalesce(avg(delay_sec), 0.0)')} AS avg_delay_sec,
       {sql_r6('coalesce(CAST(count(*) FILTER (WHERE delay_sec > 60) AS DOUBLE) * 100.0 / CAST(nullif(count(*), 0) AS DOUBLE), 0.0)')}
         AS pct_late
FROM ({_recent(24)})"""))
def q_traffic_kpis(spark, d):
    k = delays.traffic_kpis(visits(spark, d), AS_OF)
    return k.select("total_visits", "active_lines", r6("avg_delay_sec").alias("avg_delay_sec"),
                    r6("pct_late").alias("pct_late"))


def _sql_top(mode: str | None, limit: int = 10) -> str:
    flt = f"WHERE l.transport_mode = '{mode}'" if mode else ""
    return f"""
SELECT r.line_id, coalesce(l.short_name, r.line_id) AS line_name, coalesce(l.transport_mode, 'Inconnu') AS transport_mode,
       count(*) AS visits, avg(r.delay_sec) AS avg_delay_sec
FROM ({_recent(24)}) r LEFT JOIN lines l ON r.line_id = l.line_id {flt}
GROUP BY r.line_id, l.short_name, l.transport_mode HAVING count(*) >= 5
ORDER BY avg_delay_sec DESC, r.line_id LIMIT {limit}"""


def _top_out(df):
    return df.select("line_id", "line_name", "transport_mode", "visits", r6("avg_delay_sec").alias("avg_delay_sec"))


@register("top_delayed", q(f"SELECT line_id, line_name, transport_mode, visits, {sql_r6('avg_delay_sec')} AS avg_delay_sec "
                           f"FROM ({_sql_top(None)})"))
def q_top_delayed(spark, d):
    return _top_out(delays.top_delayed(visits(spark, d), A.lines(spark, d), AS_OF))


@register("top_delayed_mode", q(f"SELECT line_id, line_name, transport_mode, visits, {sql_r6('avg_delay_sec')} AS avg_delay_sec "
                                f"FROM ({_sql_top('Metro')})"))
def q_top_delayed_mode(spark, d):
    """Mode filter after the LEFT JOIN (unknown lines drop out)."""
    return _top_out(delays.top_delayed(visits(spark, d), A.lines(spark, d), AS_OF, mode="Metro"))


@register("top_delayed_display", q(f"""
SELECT line_name || ' (' || transport_mode || ')' AS label, {sql_r6('avg_delay_sec / 60.0')} AS delay_min, line_id
FROM ({_sql_top(None)})"""))
def q_top_delayed_display(spark, d):
    t = delays.top_delayed_display(delays.top_delayed(visits(spark, d), A.lines(spark, d), AS_OF))
    return t.select("label", r6("delay_min").alias("delay_min"), "line_id")


SQL_HEAT = f"""
SELECT CAST(dayofweek(recorded_at) AS INTEGER) AS day_of_week, CAST(hour(recorded_at) AS INTEGER) AS hour,
       avg(delay_sec) AS avg_delay_sec, count(*) AS visits
FROM ({_recent(24 * 7)}) GROUP BY 1, 2"""


@register("delay_heatmap", q(f"SELECT day_of_week, hour, {sql_r6('avg_delay_sec')} AS avg_delay_sec, visits "
                             f"FROM ({SQL_HEAT})"))
def q_delay_heatmap(spark, d):
    h = delays.delay_heatmap(visits(spark, d), A.lines(spark, d), AS_OF)
    return h.select("day_of_week", "hour", r6("avg_delay_sec").alias("avg_delay_sec"), "visits")


@register("delay_heatmap_grid", q(f"""
SELECT CAST(g.day_of_week AS INTEGER) AS day_of_week,
       {", ".join(f"{sql_r6(f'max(CASE WHEN h.hour = {i} THEN h.avg_delay_sec / 60.0 END)')} AS h{i:02d}" for i in range(24))}
FROM range(7) g(day_of_week) LEFT JOIN ({SQL_HEAT}) h ON h.day_of_week = g.day_of_week
GROUP BY g.day_of_week"""))
def q_delay_heatmap_grid(spark, d):
    g = delays.heatmap_grid(delays.delay_heatmap(visits(spark, d), A.lines(spark, d), AS_OF))
    return g.select("day_of_week", *[r6(f"h{i:02d}").alias(f"h{i:02d}") for i in range(24)])


@register("traffic_overview", q(f"""
SELECT count(*) AS total_samples, {sql_r6('avg(CAST(delay_seconds AS DOUBLE))')} AS overall_avg_delay,
       count(DISTINCT line_id) AS distinct_lines, max(recorded_at) AS latest
FROM stop_visits WHERE recorded_at >= {AS_OF_SQL} - INTERVAL 2 HOUR AND delay_seconds IS NOT NULL"""))
def q_traffic_overview(spark, d):
    o = delays.traffic_overview(visits(spark, d), AS_OF)
    return o.select("total_samples", r6("overall_avg_delay").alias("overall_avg_delay"), "distinct_lines", "latest")


def _names(spark, d):
    # requested names: every brand of the part table, upper-cased (matching is case-insensitive)
    return A.table(spark, d, "part").select(F.upper("p_brand").alias("name"))


@register("line_stats", q(f"""
SELECT i.name, i.n_lines > 0 AS matched, i.n_lines, i.short_name, i.transport_mode, i.network_name,
       coalesce(st.samples, 0) AS samples, {sql_r6('st.avg_delay')} AS avg_delay, st.latest
FROM info i LEFT JOIN st ON st.name = i.name""",
    names="SELECT DISTINCT upper(p_brand) AS name FROM part",
    pairs="""SELECT n.name, l.line_id, l.short_name, l.transport_mode, l.network_name
             FROM names n LEFT JOIN lines l ON lower(n.name) = lower(l.short_name)""",
    info="""SELECT name, short_name, transport_mode, network_name, n_lines FROM (
              SELECT *, row_number() OVER (PARTITION BY name ORDER BY line_id) AS rn,
                     count(line_id) OVER (PARTITION BY name) AS n_lines FROM pairs) WHERE rn = 1""",
    st=f"""SELECT p.name, count(*) AS samples, avg(CAST(v.delay_seconds AS DOUBLE)) AS avg_delay, max(v.recorded_at) AS latest
           FROM stop_visits v JOIN pairs p ON p.line_id = v.line_id
           WHERE v.recorded_at >= {AS_OF_SQL} - INTERVAL 2 HOUR AND v.delay_seconds IS NOT NULL GROUP BY p.name"""))
def q_line_stats(spark, d):
    """Line lookup by short name (case-insensitive), stats of all its ids over 2 h."""
    s = delays.line_stats(visits(spark, d), A.lines(spark, d), _names(spark, d), AS_OF)
    return s.withColumn("avg_delay", r6("avg_delay"))


OUTSIDE = "NOT coalesce(latitude BETWEEN 48.0 AND 50.0 AND longitude BETWEEN 1.5 AND 3.5, false)"


@register("bad_stations", q(f"""
SELECT station_id, station_name, latitude, longitude, count(*) AS n_rows, min(measured_at) AS first_seen,
       max(measured_at) AS last_seen
FROM air WHERE {OUTSIDE} GROUP BY station_id, station_name, latitude, longitude"""))
def q_bad_stations(spark, d):
    return delays.bad_stations(A.air_raw(spark, d))


@register("bbox_audit", q("SELECT count(*) AS n_rows, min(latitude) AS min_lat, max(latitude) AS max_lat, "
                          "min(longitude) AS min_lon, max(longitude) AS max_lon FROM air"))
def q_bbox_audit(spark, d):
    return delays.bbox_audit(A.air_raw(spark, d))


@register("bbox_filter", q("SELECT station_id, measured_at FROM air WHERE coalesce(latitude BETWEEN 48.0 AND 50.0 "
                           "AND longitude BETWEEN 1.5 AND 3.5, false)"))
def q_bbox_filter(spark, d):
    return A.air_raw(spark, d).filter(in_bbox("latitude", "longitude")).select("station_id", "measured_at")


SQL_AIR24 = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY measured_at DESC) AS rn
               FROM air WHERE measured_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) WHERE rn = 1"""


def _air24(spark, d):
    return snapshots.latest_air(A.air_raw(spark, d), AS_OF, hours=24, cols=snapshots.AIR_DASHBOARD_COLS)


@register("air_kpis", q(f"SELECT count(*) AS stations, {sql_r6('avg(aqi)')} AS mean_aqi, {sql_r6('avg(pm25)')} AS mean_pm25, "
                        f"max(measured_at) AS latest FROM ({SQL_AIR24})"))
def q_air_kpis(spark, d):
    k = delays.air_kpis(_air24(spark, d))
    return k.select("stations", r6("mean_aqi").alias("mean_aqi"), r6("mean_pm25").alias("mean_pm25"), "latest")


@register("available_modes", q("SELECT DISTINCT transport_mode FROM lines WHERE transport_mode IS NOT NULL"))
def q_available_modes(spark, d):
    return delays.available_modes(A.lines(spark, d))


@register("station_history", q(f"""
SELECT station_id, station_name, aqi, pm25, pm10, no2, measured_at FROM air
WHERE measured_at >= {AS_OF_SQL} - INTERVAL 48 HOUR AND station_id = '@7'"""))
def q_station_history(spark, d):
    return delays.station_history(A.air_raw(spark, d), AS_OF, 48, station_id="@7")


@register("station_history_all", q(f"""
SELECT station_id, station_name, aqi, pm25, pm10, no2, measured_at FROM air
WHERE measured_at >= {AS_OF_SQL} - INTERVAL 48 HOUR"""))
def q_station_history_all(spark, d):
    return delays.station_history(A.air_raw(spark, d), AS_OF, 48)


@register("enrich_visits", q("""
SELECT v.stop_id, v.line_id, v.recorded_at, coalesce(l.short_name, v.line_name, v.line_id) AS display_line_name,
       coalesce(l.transport_mode, v.transport_mode) AS display_mode, l.network_name
FROM stop_visits v LEFT JOIN lines l ON l.line_id = v.line_id"""))
def q_enrich_visits(spark, d):
    """Every visit with its line's name and mode."""
    e = delays.enrich_visits(visits(spark, d), A.lines(spark, d), hours=None)
    return e.select("stop_id", "line_id", "recorded_at", "display_line_name", "display_mode", "network_name")


@register("recent_visits", q(f"""
SELECT v.recorded_at, v.stop_id, v.line_id, v.delay_seconds, coalesce(l.short_name, v.line_name, v.line_id) AS display_line_name,
       coalesce(l.transport_mode, v.transport_mode) AS display_mode, l.color_web_hex
FROM stop_visits v LEFT JOIN lines l ON l.line_id = v.line_id WHERE v.recorded_at >= {AS_OF_SQL} - INTERVAL 24 HOUR"""))
def q_recent_visits(spark, d):
    """Enriched visits of the last 24 hours, newest first."""
    e = delays.enrich_visits(visits(spark, d), A.lines(spark, d), AS_OF)
    return e.select("recorded_at", "stop_id", "line_id", "delay_seconds", "display_line_name", "display_mode", "color_web_hex")


@register("known_lines", q("SELECT stop_id, line_id, recorded_at FROM stop_visits v "
                           "WHERE EXISTS (SELECT 1 FROM lines l WHERE l.line_id = v.line_id)"))
def q_known_lines(spark, d):
    return delays.known_lines(visits(spark, d), A.lines(spark, d)).select("stop_id", "line_id", "recorded_at")


@register("unknown_lines", q("SELECT stop_id, line_id, recorded_at FROM stop_visits v "
                             "WHERE NOT EXISTS (SELECT 1 FROM lines l WHERE l.line_id = v.line_id)"))
def q_unknown_lines(spark, d):
    return delays.unknown_lines(visits(spark, d), A.lines(spark, d)).select("stop_id", "line_id", "recorded_at")


@register("lookup_lines", q("""
SELECT v.line_id, l.short_name, l.transport_mode,
       coalesce(nullif(l.short_name, ''), nullif(l.long_name, ''), nullif(regexp_extract(v.line_id, '([^:]+):*$', 1), ''),
                v.line_id) AS display_name
FROM (SELECT DISTINCT line_id FROM stop_visits) v LEFT JOIN lines l ON l.line_id = v.line_id"""))
def q_lookup_lines(spark, d):
    """Attribute lookup for every fact line id (NULL attributes when unknown)."""
    ids = visits(spark, d).select("line_id").distinct()
    dim = A.lines(spark, d).select("line_id", "short_name", "long_name", "transport_mode")
    j = ids.join(dim, "line_id", "left")
    return j.select("line_id", "short_name", "transport_mode",
                    mb.display_name("short_name", "long_name", "line_id").alias("display_name"))


@register("lookup_size", q("SELECT count(DISTINCT line_id) AS n_lines FROM lines"))
def q_lookup_size(spark, d):
    return A.lines(spark, d).agg(F.count_distinct("line_id").alias("n_lines"))


@register("trailing_window", q(f"SELECT stop_id, line_id, recorded_at FROM stop_visits "
                               f"WHERE recorded_at >= {AS_OF_SQL} - INTERVAL 2 HOUR"))
def q_trailing_window(spark, d):
    return snapshots.trailing(visits(spark, d), "recorded_at", AS_OF, hours=2).select("stop_id", "line_id", "recorded_at")


@register("trailing_window_h", q(f"SELECT station_id, measured_at FROM air WHERE measured_at >= {AS_OF_SQL} - INTERVAL 36 HOUR"))
def q_trailing_window_h(spark, d):
    return snapshots.trailing(A.air_raw(spark, d), "measured_at", AS_OF, hours=36).select("station_id", "measured_at")


@register("name_contains", q(f"""
SELECT station_id, station_name FROM ({SQL_AIR24}) WHERE contains(lower(coalesce(station_name, '')), 'défense')"""))
def q_name_contains(spark, d):
    return dashboard.name_contains(_air24(spark, d), "défense", ["station_name"]).select("station_id", "station_name")


@register("name_or_id_contains", q(f"""
SELECT point_id, point_name FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY observed_at DESC) AS rn
  FROM weather WHERE observed_at >= {AS_OF_SQL} - INTERVAL 3 HOUR) WHERE rn = 1
  AND (contains(lower(coalesce(point_name, '')), 'p1') OR contains(lower(coalesce(point_id, '')), 'p1'))"""))
def q_name_or_id_contains(spark, d):
    s = snapshots.latest_weather(A.weather_raw(spark, d), AS_OF)
    return dashboard.name_contains(s, "p1", ["point_name", "point_id"]).select("point_id", "point_name")


NEEDLES_SQL = "SELECT DISTINCT substr(lower(p_name), 1 + p_partkey % 7, 2 + p_partkey % 5) AS needle FROM part"


@register("substring_search", q("""
SELECT needle, line_id FROM needles, lines
WHERE needle <> '' AND (contains(lower(coalesce(long_name, '')), needle) OR contains(lower(coalesce(line_id, '')), needle))""",
                                needles=NEEDLES_SQL))
def q_substring_search(spark, d):
    """Every needle (pieces of part names) against all line names and ids, through stored trigram postings."""
    piece = F.substring(F.lower("p_name"), (1 + F.col("p_partkey") % 7).cast("int"), (2 + F.col("p_partkey") % 5).cast("int"))
    needles = A.table(spark, d, "part").select(piece.alias("needle"))
    items = A.lines(spark, d).select("line_id", "long_name")
    return substrings.matches(needles, "needle", items, ["long_name", "line_id"]).select("needle", "line_id")


def _aqi_sql(col: str, pick: int) -> str:
    arms = " ".join(f"WHEN {col} <= {b[0]} THEN '{b[pick]}'" for b in fm.AQI_BANDS)
    return f"(CASE WHEN {col} IS NULL THEN '{fm.AQI_MISSING[pick - 1]}' {arms} ELSE '{fm.AQI_TOP[pick - 1]}' END)"


@register("map_layer", q(f"""
SELECT latitude, longitude, {_aqi_sql('aqi', 3)} AS color, station_name AS label
FROM ({SQL_AIR24}) WHERE latitude IS NOT NULL AND longitude IS NOT NULL"""))
def q_map_layer(spark, d):
    return dashboard.map_layer(_air24(spark, d))


@register("aqi_category", q(f"SELECT station_id, measured_at, aqi, {_aqi_sql('aqi', 1)} AS category, "
                            f"{_aqi_sql('aqi', 2)} AS label, {_aqi_sql('aqi', 3)} AS color FROM air"))
def q_aqi_category(spark, d):
    a = A.air_raw(spark, d)
    return a.select("station_id", "measured_at", "aqi", fm.aqi_category("aqi").alias("category"),
                    fm.aqi_label("aqi").alias("label"), fm.aqi_color("aqi").alias("color"))


@register("station_table", q(f"""
SELECT station_name AS "Station",
       CASE WHEN aqi IS NULL THEN '?' ELSE CAST(aqi AS VARCHAR) || ' — ' || {_aqi_sql('aqi', 2)} END AS "AQI",
       CASE WHEN pm25 IS NULL THEN '—' ELSE printf('%.0f', pm25) END AS "PM2.5",
       CASE WHEN no2 IS NULL THEN '—' ELSE printf('%.0f', no2) END AS "NO₂",
       attribution AS "Source"
FROM ({SQL_AIR24})"""))
def q_station_table(spark, d):
    """Station table of the air page: AQI with label, rounded PM2.5 / NO2, renamed columns."""
    return dashboard.station_table(_air24(spark, d))


@register("has_precipitation", q("SELECT point_id, observed_at, coalesce(precipitation_mm > 0, false) OR "
                                 "coalesce(rain_mm > 0, false) OR coalesce(snowfall_cm > 0, false) AS has_precipitation "
                                 "FROM weather"))
def q_has_precipitation(spark, d):
    w = A.weather_raw(spark, d)
    return w.select("point_id", "observed_at", fm.has_precipitation().alias("has_precipitation"))


@register("visit_times", q("""
SELECT stop_id, line_id, recorded_at, delay_seconds,
       coalesce(expected_arrival, expected_departure, aimed_arrival, aimed_departure) AS best_time
FROM stop_visits"""))
def q_visit_times(spark, d):
    """Stored delay (arrival pair else departure pair) and best time of every visit."""
    v = visits(spark, d)
    return v.select("stop_id", "line_id", "recorded_at", "delay_seconds", mb.best_time().alias("best_time"))


@register("format_delay", q("""
SELECT stop_id, line_id, recorded_at, delay_seconds,
       CASE WHEN delay_seconds IS NULL THEN '?'
            WHEN delay_seconds > 60 THEN '+' || CAST(CAST(floor(delay_seconds / 60.0) AS BIGINT) AS VARCHAR) || ' min'
            WHEN delay_seconds < -60 THEN CAST(CAST(floor(delay_seconds / 60.0) AS BIGINT) AS VARCHAR) || ' min'
            ELSE 'à l''heure' END AS delay_text,
       CASE WHEN delay_seconds IS NULL THEN NULL WHEN delay_seconds = 0 THEN '0s'
            WHEN abs(delay_seconds) < 60 THEN (CASE WHEN delay_seconds > 0 THEN '+' ELSE '-' END) || CAST(abs(delay_seconds) AS VARCHAR) || 's'
            ELSE (CASE WHEN delay_seconds > 0 THEN '+' ELSE '-' END) || CAST(abs(delay_seconds) // 60 AS VARCHAR) || 'm '
                 || CAST(abs(delay_seconds) % 60 AS VARCHAR) || 's' END AS delay_clock
FROM stop_visits"""))
def q_format_delay(spark, d):
    """Both delay texts (console minutes, UI clock) of every stored delay."""
    v = visits(spark, d)
    return v.select("stop_id", "line_id", "recorded_at", "delay_seconds",
                    fm.format_delay_minutes("delay_seconds").alias("delay_text"),
                    fm.format_delay_clock("delay_seconds").alias("delay_clock"))


def _age_sql(col: str) -> str:
    dd = f"(epoch_us({AS_OF_SQL}) - epoch_us({col}))"
    return (f"CASE WHEN {col} IS NULL THEN '?' WHEN {dd} < 60000000 THEN 'à l''instant' "
            f"WHEN {dd} < 3600000000 THEN 'il y a ' || CAST({dd} // 60000000 AS VARCHAR) || ' min' "
            f"WHEN {dd} < 86400000000 THEN 'il y a ' || CAST({dd} // 3600000000 AS VARCHAR) || 'h' "
            f"ELSE 'il y a ' || CAST({dd} // 86400000000 AS VARCHAR) || 'j' END")


def _age_short_sql(col: str) -> str:
    m = f"((epoch_us({AS_OF_SQL}) - epoch_us({col})) // 60000000)"
    return (f"CASE WHEN {col} IS NULL THEN '?' WHEN {m} < 60 THEN 'il y a ' || CAST({m} AS VARCHAR) || ' min' "
            f"ELSE 'il y a ' || CAST({m} // 60 AS VARCHAR) || 'h' END")


@register("format_age", q(f"SELECT station_id, measured_at, {_age_sql('measured_at')} AS age_text, "
                          f"{_age_short_sql('measured_at')} AS age_short FROM ({SQL_AIR24})"))
def q_format_age(spark, d):
    s = _air24(spark, d)
    return s.select("station_id", "measured_at", fm.format_age("measured_at", F.lit(AS_OF).cast("timestamp")).alias("age_text"),
                    fm.format_age_short("measured_at", F.lit(AS_OF).cast("timestamp")).alias("age_short"))


@register("scan_project", q("SELECT line_id, short_name, transport_mode FROM lines"))
def q_scan_project(spark, d):
    """Dimension scan reading three columns (the parquet scan prunes the rest)."""
    return A.lines(spark, d).select("line_id", "short_name", "transport_mode")



# ---------------------------------------------------------------- large fact table (order lines as visits)
ALL_TIME_H = 24 * 365 * 30
LARGE = {"stop_visits": A.SQL_STOP_VISITS_LARGE, "lines": A.SQL_LINES}
ARR_L = "(epoch_us(expected_arrival) - epoch_us(aimed_arrival)) / 1000000.0"
RECENT_L = (f"SELECT *, {ARR_L} AS delay_sec FROM stop_visits WHERE recorded_at >= TIMESTAMP '{A.AS_OF_LARGE}' - "
            f"INTERVAL {ALL_TIME_H} HOUR AND aimed_arrival IS NOT NULL AND expected_arrival IS NOT NULL")


def _large(spark, d):
    from metroscope.operators.facts import stop_visit_rows
    return stop_visit_rows(A.stop_visits_large_raw(spark, d))


@register("traffic_kpis_large", A.with_views(f"""
SELECT count(*) AS total_visits, count(DISTINCT line_id) AS active_lines,
       {sql_r6('coalesce(avg(delay_sec), 0.0)')} AS avg_delay_sec,
       {sql_r6('coalesce(CAST(count(*) FILTER (WHERE delay_sec > 60) AS DOUBLE) * 100.0 / CAST(nullif(count(*), 0) AS DOUBLE), 0.0)')}
         AS pct_late
FROM ({RECENT_L})""", **LARGE))
def q_traffic_kpis_large(spark, d):
    """KPIs over the order-line fact table (every row in the window)."""
    k = delays.traffic_kpis(_large(spark, d), A.AS_OF_LARGE, hours=ALL_TIME_H)
    return k.select("total_visits", "active_lines", r6("avg_delay_sec").alias("avg_delay_sec"),
                    r6("pct_late").alias("pct_late"))


@register("top_delayed_large", A.with_views(f"""
SELECT line_id, line_name, transport_mode, visits, {sql_r6('avg_delay_sec')} AS avg_delay_sec FROM (
  SELECT r.line_id, coalesce(l.short_name, r.line_id) AS line_name, coalesce(l.transport_mode, 'Inconnu') AS transport_mode,
         count(*) AS visits, avg(r.delay_sec) AS avg_delay_sec
  FROM ({RECENT_L}) r LEFT JOIN lines l ON r.line_id = l.line_id
  GROUP BY r.line_id, l.short_name, l.transport_mode HAVING count(*) >= 5
  ORDER BY avg_delay_sec DESC, r.line_id LIMIT 10)""", **LARGE))
def q_top_delayed_large(spark, d):
    """League table over the order-line fact table, joined with the line dimension."""
    t = delays.top_delayed(_large(spark, d), A.lines(spark, d), A.AS_OF_LARGE, hours=ALL_TIME_H)
    return _top_out(t)


@register("delay_heatmap_large", A.with_views(f"""
SELECT CAST(dayofweek(recorded_at) AS INTEGER) AS day_of_week, CAST(hour(recorded_at) AS INTEGER) AS hour,
       {sql_r6('avg(delay_sec)')} AS avg_delay_sec, count(*) AS visits
FROM ({RECENT_L}) GROUP BY 1, 2""", **LARGE))
def q_delay_heatmap_large(spark, d):
    h = delays.delay_heatmap(_large(spark, d), A.lines(spark, d), A.AS_OF_LARGE, hours=ALL_TIME_H)
    return h.select("day_of_week", "hour", r6("avg_delay_sec").alias("avg_delay_sec"), "visits")

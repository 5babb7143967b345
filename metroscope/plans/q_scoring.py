"""Registered queries: snapshots, spatial matching and journey scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from metroscope.functions import formats as fs_formats
from metroscope.functions import scores as fs
from metroscope.operators import dashboard, scoring, snapshots, spatial
from metroscope.plans import adapters as A
from metroscope.plans import sql_exprs as X
from metroscope.plans.queries import AS_OF_SQL, r6, r6_pairs, register, views, visits
from metroscope.sources import constants

AS_OF = A.AS_OF

# ------------------------------------------------------------------ oracle building blocks
SQL_AIR_LATEST = f"""
SELECT station_id, station_name, latitude, longitude, aqi, pm25, pm10, no2, measured_at FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY measured_at DESC) AS rn
  FROM air WHERE measured_at >= {AS_OF_SQL} - INTERVAL 6 HOUR) WHERE rn = 1"""
SQL_WX_LATEST = f"""
SELECT point_id, point_name, latitude, longitude, temperature_c, precipitation_mm, wind_speed_ms, uv_index,
       observed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY observed_at DESC) AS rn
  FROM weather WHERE observed_at >= {AS_OF_SQL} - INTERVAL 3 HOUR) WHERE rn = 1"""
SQL_TRAFFIC = f"""
SELECT avg(CAST(delay_seconds AS DOUBLE)) AS avg_delay_seconds, CAST(count(*) AS INTEGER) AS sample_count
FROM stop_visits WHERE recorded_at >= {AS_OF_SQL} - INTERVAL 24 HOUR AND delay_seconds IS NOT NULL"""


def _sql_nearest(snap: str, sid: str, cols: list[str]) -> str:
    d = X.haversine("w.latitude", "w.longitude", "s.latitude", "s.longitude")
    sel = ", ".join(f"s.{c}" for c in cols)
    return f"""
SELECT journey_id, pos, sid, d, {", ".join(cols)} FROM (
  SELECT w.journey_id, w.pos, s.{sid} AS sid, {d} AS d, {sel},
         row_number() OVER (PARTITION BY w.journey_id, w.pos ORDER BY {d}, s.{sid}) AS rn
  FROM waypoints w, {snap} s) WHERE rn = 1"""


_FAR = scoring.WARN_FAR_STATION.partition("{}")
SQL_EXPOSURE = f"""
SELECT w.journey_id, w.pos, w.latitude, w.longitude,
       an.sid AS air_id, an.d AS air_distance_km, an.pm25 AS air_pm25, an.no2 AS air_no2, an.aqi AS air_aqi,
       xn.sid AS wx_id, xn.d AS wx_distance_km, xn.temperature_c AS wx_temperature_c,
       xn.precipitation_mm AS wx_precipitation_mm, xn.wind_speed_ms AS wx_wind_speed_ms, xn.uv_index AS wx_uv_index,
       t.avg_delay_seconds AS traffic_avg_delay_seconds, t.sample_count AS traffic_sample_count
FROM waypoints w
LEFT JOIN ({_sql_nearest('air_latest', 'station_id', ['pm25', 'no2', 'aqi'])}) an
  ON an.journey_id = w.journey_id AND an.pos = w.pos
LEFT JOIN ({_sql_nearest('wx_latest', 'point_id', ['temperature_c', 'precipitation_mm', 'wind_speed_ms', 'uv_index'])}) xn
  ON xn.journey_id = w.journey_id AND xn.pos = w.pos
CROSS JOIN traffic t"""
SQL_SCORED_WP = f"""
SELECT e.*, {X.pollution('air_pm25', 'air_no2', 'air_aqi')} AS pollution_score,
       {X.weather('wx_temperature_c', 'wx_precipitation_mm', 'wx_wind_speed_ms', 'wx_uv_index')} AS weather_score,
       {X.traffic('traffic_avg_delay_seconds', 'traffic_sample_count')} AS traffic_score,
       CASE WHEN air_distance_km > 5.0 THEN '{_FAR[0]}' || printf('%.1f', air_distance_km) || '{_FAR[2]}' END AS warning
FROM exposure e"""

SCORING_VIEWS = dict(views("stop_visits", "air", "weather", "waypoints", "journeys"))
SCORING_VIEWS.update({"air_latest": SQL_AIR_LATEST, "wx_latest": SQL_WX_LATEST, "traffic": SQL_TRAFFIC,
                      "exposure": SQL_EXPOSURE, "scored_wp": SQL_SCORED_WP})

SQL_JOURNEY_AGG = f"""
SELECT j.journey_id, j.journey_label, j.comparison_id, j.input_pos, count(*) AS n_waypoints,
       avg(s.pollution_score) AS ps, avg(s.weather_score) AS ws, avg(s.traffic_score) AS ts,
       coalesce(array_to_string(list_sort(list_distinct(list(s.warning) FILTER (WHERE s.warning IS NOT NULL)))
                || CASE WHEN (SELECT count(*) FROM air_latest) = 0 THEN ['{scoring.WARN_NO_AIR}'] ELSE [] END
                || CASE WHEN (SELECT count(*) FROM wx_latest) = 0 THEN ['{scoring.WARN_NO_WEATHER}'] ELSE [] END,
                ' | '), '') AS warnings_text
FROM journeys j JOIN scored_wp s ON s.journey_id = j.journey_id
GROUP BY j.journey_id, j.journey_label, j.comparison_id, j.input_pos"""
SCORING_VIEWS["journey_agg"] = SQL_JOURNEY_AGG


def _scored(spark, d, weights=None):
    return scoring.score_journeys(A.journeys(spark, d), A.waypoints(spark, d), A.air_raw(spark, d),
                                  A.weather_raw(spark, d), visits(spark, d), AS_OF, weights=weights)


def _flat(df):
    return df.select("journey_id", "journey_label", "n_waypoints",
                     r6("pollution_score").alias("pollution_score"), r6("weather_score").alias("weather_score"),
                     r6("traffic_score").alias("traffic_score"), r6("overall_score").alias("overall_score"),
                     "grade", F.array_join("warnings", " | ").alias("warnings_text"))


@register("journey_score", A.with_views(f"""
SELECT journey_id, journey_label, n_waypoints, round(1e-9 + ps, 6) AS pollution_score, round(1e-9 + ws, 6) AS weather_score,
       round(1e-9 + ts, 6) AS traffic_score, round(1e-9 + {X.total('ps', 'ws', 'ts')}, 6) AS overall_score,
       {X.grade(X.total('ps', 'ws', 'ts'))} AS grade, warnings_text
FROM journey_agg""", **SCORING_VIEWS))
def q_journey_score(spark, d):
    """Flagship: A–E health score of every journey against one as-of snapshot."""
    return _flat(_scored(spark, d))


CUSTOM_WEIGHTS = {"pollution": 0.4, "weather": 0.4, "traffic": 0.2}


@register("journey_score_weights", A.with_views(f"""
SELECT journey_id, round(1e-9 + {X.total('ps', 'ws', 'ts', CUSTOM_WEIGHTS)}, 6) AS overall_score,
       {X.grade(X.total('ps', 'ws', 'ts', CUSTOM_WEIGHTS))} AS grade
FROM journey_agg""", **SCORING_VIEWS))
def q_journey_score_weights(spark, d):
    """Custom weights change the journey total only (waypoints keep defaults)."""
    return _scored(spark, d, CUSTOM_WEIGHTS).select("journey_id", r6("overall_score").alias("overall_score"), "grade")


@register("waypoint_exposure", A.with_views("""
SELECT journey_id, pos, air_id, round(1e-9 + air_distance_km, 6) AS air_distance_km, wx_id,
       round(1e-9 + wx_distance_km, 6) AS wx_distance_km, round(1e-9 + pollution_score, 6) AS pollution_score,
       round(1e-9 + weather_score, 6) AS weather_score, round(1e-9 + traffic_score, 6) AS traffic_score,
       round(1e-9 + """ + X.total("pollution_score", "weather_score", "traffic_score") + """, 6) AS overall_score, warning
FROM scored_wp""", **SCORING_VIEWS))
def q_waypoint_exposure(spark, d):
    air = scoring.materialize(snapshots.latest_air(A.air_raw(spark, d), AS_OF))
    wx = scoring.materialize(snapshots.latest_weather(A.weather_raw(spark, d), AS_OF))
    ex = scoring.score_waypoints(A.waypoints(spark, d), air, wx, scoring.traffic_stats(visits(spark, d), AS_OF))
    return ex.select("journey_id", "pos", "air_id", r6("air_distance_km").alias("air_distance_km"), "wx_id",
                     r6("wx_distance_km").alias("wx_distance_km"), r6("pollution_score").alias("pollution_score"),
                     r6("weather_score").alias("weather_score"), r6("traffic_score").alias("traffic_score"),
                     r6("overall_score").alias("overall_score"), "warning")


def _nearest_query(strategy):
    def q(spark, d):
        air = scoring.materialize(snapshots.latest_air(A.air_raw(spark, d), AS_OF)).withColumnRenamed(
            "station_id", "sensor_id")
        out = spatial.nearest(A.waypoints(spark, d), air, ["journey_id", "pos"], payload=["aqi"], prefix="air_",
                              strategy=strategy)
        return out.select("journey_id", "pos", "air_id", r6("air_distance_km").alias("air_distance_km"), "air_aqi")
    return q


SQL_NEAREST = A.with_views(f"""
SELECT w.journey_id, w.pos, n.sid AS air_id, round(1e-9 + n.d, 6) AS air_distance_km, n.aqi AS air_aqi
FROM waypoints w LEFT JOIN ({_sql_nearest('air_latest', 'station_id', ['aqi'])}) n
  ON n.journey_id = w.journey_id AND n.pos = w.pos""", **SCORING_VIEWS)
register("nearest_sensor", SQL_NEAREST)(_nearest_query("auto"))
register("nearest_sensor_grid", SQL_NEAREST)(_nearest_query("grid"))
register("nearest_sensor_scan", SQL_NEAREST)(_nearest_query("scan"))
register("nearest_sensor_cells", SQL_NEAREST)(_nearest_query("cells"))

RADIUS_KM = 5.0


@register("within_radius", A.with_views(f"""
SELECT w.journey_id, w.pos, s.station_id AS s_id,
       round(1e-9 + {X.haversine('w.latitude', 'w.longitude', 's.latitude', 's.longitude')}, 6) AS s_distance_km
FROM waypoints w, air_latest s
WHERE {X.haversine('w.latitude', 'w.longitude', 's.latitude', 's.longitude')} <= {RADIUS_KM}""", **SCORING_VIEWS))
def q_within_radius(spark, d):
    """All stations within 5 km of each waypoint (inclusive)."""
    air = snapshots.latest_air(A.air_raw(spark, d), AS_OF).withColumnRenamed("station_id", "sensor_id")
    out = spatial.within_radius(A.waypoints(spark, d), air, RADIUS_KM)
    return out.select("journey_id", "pos", "s_id", r6_pairs("s_distance_km").alias("s_distance_km"))


@register("latest_air_6h", A.with_views("SELECT * FROM air_latest", **SCORING_VIEWS))
def q_latest_air_6h(spark, d):
    return snapshots.latest_air(A.air_raw(spark, d), AS_OF)


@register("latest_weather_3h", A.with_views("SELECT * FROM wx_latest", **SCORING_VIEWS))
def q_latest_weather_3h(spark, d):
    return snapshots.latest_weather(A.weather_raw(spark, d), AS_OF)


@register("latest_air_24h", A.with_views(f"""
SELECT {", ".join(snapshots.AIR_DASHBOARD_COLS)} FROM (
  SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY measured_at DESC) AS rn
  FROM air WHERE measured_at >= {AS_OF_SQL} - INTERVAL 24 HOUR) WHERE rn = 1""", **views("air")))
def q_latest_air_24h(spark, d):
    return snapshots.latest_air(A.air_raw(spark, d), AS_OF, hours=24, cols=snapshots.AIR_DASHBOARD_COLS)


@register("traffic_stats", A.with_views("SELECT round(1e-9 + avg_delay_seconds, 6) AS avg_delay_seconds, sample_count "
                                        "FROM traffic", **SCORING_VIEWS))
def q_traffic_stats(spark, d):
    t = scoring.traffic_stats(visits(spark, d), AS_OF)
    return t.select(r6("avg_delay_seconds").alias("avg_delay_seconds"), "sample_count")


@register("compare_journeys", A.with_views(f"""
SELECT comparison_id, count(*) AS n_journeys,
       arg_max(journey_id, (tot, -input_pos)) AS best_journey_id,
       arg_min(journey_id, (tot, input_pos)) AS worst_journey_id,
       round(1e-9 + max(tot) - min(tot), 6) AS score_gap, max(tot) - min(tot) >= 5.0 AS is_significant
FROM (SELECT *, {X.total('ps', 'ws', 'ts')} AS tot FROM journey_agg) GROUP BY comparison_id""", **SCORING_VIEWS))
def q_compare_journeys(spark, d):
    """Best / worst journey and score gap per comparison (nation)."""
    c = scoring.compare_journeys(_scored(spark, d))
    return c.withColumn("score_gap", r6("score_gap"))


@register("rank_journeys", A.with_views(f"""
SELECT comparison_id, journey_id, CAST(row_number() OVER (PARTITION BY comparison_id ORDER BY tot DESC, input_pos)
       AS INTEGER) AS rank
FROM (SELECT *, {X.total('ps', 'ws', 'ts')} AS tot FROM journey_agg)""", **SCORING_VIEWS))
def q_rank_journeys(spark, d):
    return scoring.rank_journeys(_scored(spark, d)).select("comparison_id", "journey_id", "rank")


@register("journey_midpoint", A.with_views("""
SELECT journey_id, round(1e-9 + avg(latitude), 6) AS mid_latitude, round(1e-9 + avg(longitude), 6) AS mid_longitude
FROM waypoints GROUP BY journey_id""", **views("waypoints")))
def q_journey_midpoint(spark, d):
    w = A.waypoints(spark, d)
    return w.groupBy("journey_id").agg(r6(F.avg("latitude")).alias("mid_latitude"),
                                       r6(F.avg("longitude")).alias("mid_longitude"))


SQL_SHORT_TRIPS = """
SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS journey_id, i AS pos,
       48.0 + CAST((o_orderkey * (CASE i WHEN 0 THEN 7 ELSE 5 END)) % 6 AS DOUBLE) AS latitude,
       2.0 + CAST(o_orderkey % 2 AS DOUBLE) AS longitude
FROM orders, (VALUES (0), (1)) t(i) WHERE o_orderkey % 53 <> 0 AND (i = 0 OR o_orderkey % 7 <> 0)"""


def _short_trips(spark, d):
    """Journeys of up to two grid points, some without a point (stand-in input)."""
    k = F.col("o_orderkey")
    o = A.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    journeys = o.select(F.concat(F.lit("O"), k.cast("string")).alias("journey_id"), F.concat(F.lit("T"), k.cast("string")).alias("journey_label"),
                        F.concat(F.lit("C"), F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("comparison_id"))
    point = lambda i, m: F.struct(F.lit(i).alias("pos"), (F.lit(48.0) + (k * m % 6).cast("double")).alias("latitude"),
                                  (F.lit(2.0) + (k % 2).cast("double")).alias("longitude"))
    points = F.when(k % 7 != 0, F.array(point(0, 7), point(1, 5))).otherwise(F.array(point(0, 7)))
    wps = (o.filter(k % 53 != 0).select(F.concat(F.lit("O"), k.cast("string")).alias("journey_id"), F.explode(points).alias("p"))
           .select("journey_id", "p.*"))
    return journeys, wps


@register("journey_valid", A.with_views("""
SELECT 'O' || CAST(o_orderkey AS VARCHAR) AS journey_id, 'T' || CAST(o_orderkey AS VARCHAR) AS journey_label,
       CASE WHEN n IS NULL THEN 'Le trajet doit avoir au moins un waypoint'
            ELSE 'Le départ et l''arrivée sont identiques — choisis 2 zones différentes.' END AS reason
FROM orders LEFT JOIN (
  SELECT journey_id, count(*) AS n, arg_min(latitude, pos) = arg_max(latitude, pos) AND arg_min(longitude, pos) = arg_max(longitude, pos) AS same
  FROM trips GROUP BY journey_id) e ON e.journey_id = 'O' || CAST(o_orderkey AS VARCHAR)
WHERE n IS NULL OR (n > 1 AND same)""", trips=SQL_SHORT_TRIPS))
def q_journey_valid(spark, d):
    """Journeys rejected by the guards: no waypoint, or start equal to end."""
    return scoring.invalid_journeys(*_short_trips(spark, d)).select("journey_id", "journey_label", "reason")


@register("comparison_valid", """
SELECT 'C' || CAST(o_custkey AS VARCHAR) || o_orderpriority AS comparison_id, count(*) AS n_journeys,
       '[NO_DATA] Il faut au moins 2 trajets à comparer.' AS reason FROM orders GROUP BY o_custkey, o_orderpriority HAVING count(*) < 2""")
def q_comparison_valid(spark, d):
    """Comparisons rejected for having fewer than two journeys."""
    return scoring.invalid_comparisons(_short_trips(spark, d)[0])


def _nested(spark, d):
    air = scoring.materialize(snapshots.latest_air(A.air_raw(spark, d), AS_OF))
    wx = scoring.materialize(snapshots.latest_weather(A.weather_raw(spark, d), AS_OF))
    # scored once, read for the totals and for the nested lists
    ex = scoring.materialize(scoring.score_waypoints(A.waypoints(spark, d), air, wx, scoring.traffic_stats(visits(spark, d), AS_OF)))
    scored = scoring.score_journeys(A.journeys(spark, d), None, A.air_raw(spark, d), A.weather_raw(spark, d),
                                    visits(spark, d), AS_OF, exposures=ex)
    return scoring.nest_journeys(scored, ex)


@register("journey_nested", None)
def q_journey_nested(spark, d):
    """Nested journey result (ordered exposures, weights map, evaluation time)."""
    return _nested(spark, d)


@register("journey_nested_rows", A.with_views("""
SELECT j.journey_id, j.comparison_id, CAST(row_number() OVER (PARTITION BY w.journey_id ORDER BY w.pos) - 1 AS INTEGER) AS idx,
       w.air_id, w.wx_id, round(1e-9 + w.pollution_score, 6) AS pollution_score, round(1e-9 + w.weather_score, 6) AS weather_score,
       CAST(0.6 AS DOUBLE) AS w_pollution, CAST(0.3 AS DOUBLE) AS w_weather, CAST(0.1 AS DOUBLE) AS w_traffic
FROM journeys j JOIN scored_wp w USING (journey_id)""", **SCORING_VIEWS))
def q_journey_nested_rows(spark, d):
    """The nested journey result flattened again: list order, scores and weights."""
    n = _nested(spark, d).select("journey_id", "comparison_id", "weights", F.posexplode("waypoints").alias("idx", "e"))
    return n.select("journey_id", "comparison_id", "idx", F.col("e.air_id").alias("air_id"), F.col("e.wx_id").alias("wx_id"),
                    r6("e.pollution_score").alias("pollution_score"), r6("e.weather_score").alias("weather_score"),
                    *[F.col("weights")[k].alias(f"w_{k}") for k in ("pollution", "weather", "traffic")])


@register("score_grid", A.with_views(f"""
SELECT station_id, measured_at, round(1e-9 + {X.pollution('pm25', 'no2', 'aqi')}, 6) AS pollution_score,
       {X.grade(X.pollution('pm25', 'no2', 'aqi'))} AS grade
FROM air""", **views("air")))
def q_score_grid(spark, d):
    """Pollution sub-score and grade of every air measurement (step grids, renormalised weights)."""
    a = A.air_raw(spark, d)
    p = fs.pollution_score("pm25", "no2", "aqi")
    return a.select("station_id", "measured_at", r6(p).alias("pollution_score"), fs.grade(p).alias("grade"))


@register("weather_score", A.with_views(f"""
SELECT point_id, observed_at,
       round(1e-9 + {X.weather('temperature_c', 'precipitation_mm', 'wind_speed_ms', 'uv_index')}, 6) AS weather_score
FROM weather""", **views("weather")))
def q_weather_score(spark, d):
    w = A.weather_raw(spark, d)
    return w.select("point_id", "observed_at",
                    r6(fs.weather_score("temperature_c", "precipitation_mm", "wind_speed_ms", "uv_index")).alias(
                        "weather_score"))


@register("traffic_score", A.with_views(f"""
SELECT line_id, round(1e-9 + {X.traffic('avg_d', 'n')}, 6) AS traffic_score FROM (
  SELECT line_id, avg(CAST(delay_seconds AS DOUBLE)) AS avg_d, CAST(count(delay_seconds) AS INTEGER) AS n
  FROM stop_visits GROUP BY line_id)""", **views("stop_visits")))
def q_traffic_score(spark, d):
    """Traffic sub-score per line from its mean stored delay and sample count."""
    v = visits(spark, d).groupBy("line_id").agg(F.avg(F.col("delay_seconds").cast("double")).alias("avg_d"),
                                                F.count("delay_seconds").cast("int").alias("n"))
    return v.select("line_id", r6(fs.traffic_score("avg_d", "n")).alias("traffic_score"))


@register("score_range_check", A.with_views("""
SELECT count(*) AS checked,
       count(*) FILTER (WHERE NOT (pollution_score BETWEEN 0 AND 100 AND weather_score BETWEEN 0 AND 100
                                   AND traffic_score BETWEEN 0 AND 100)) AS rejected
FROM scored_wp""", **SCORING_VIEWS))
def q_score_range_check(spark, d):
    """Data-quality gate: every waypoint sub-score must lie in 0..100."""
    air = scoring.materialize(snapshots.latest_air(A.air_raw(spark, d), AS_OF))
    wx = scoring.materialize(snapshots.latest_weather(A.weather_raw(spark, d), AS_OF))
    ex = scoring.score_waypoints(A.waypoints(spark, d), air, wx, scoring.traffic_stats(visits(spark, d), AS_OF))
    return dashboard.score_range_check(ex)


def _color_sql(col, mapping, default=None, upper=False):
    c = f"upper({col})" if upper else col
    arms = " ".join(f"WHEN {c} = '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in mapping.items())
    return f"(CASE {arms} ELSE {('NULL' if default is None else repr(default))} END)"


@register("grade_colors", A.with_views(f"""
SELECT journey_id, g AS grade, {_color_sql('g', fs_formats.GRADE_COLORS_SERVICE)} AS service_color,
       {_color_sql('g', fs_formats.GRADE_COLORS_UI, fs_formats.GRADE_COLOR_UNKNOWN, upper=True)} AS ui_color,
       {_color_sql('g', fs_formats.ADVICE_BY_GRADE)} AS advice
FROM (SELECT journey_id, {X.grade(X.total('ps', 'ws', 'ts'))} AS g FROM journey_agg)""", **SCORING_VIEWS))
def q_grade_colors(spark, d):
    """Grade -> both colour palettes and the advice text, per journey."""
    s = _scored(spark, d)
    return s.select("journey_id", "grade", fs_formats.grade_color("grade").alias("service_color"),
                    fs_formats.grade_color("grade", "ui").alias("ui_color"),
                    fs_formats.grade_advice("grade").alias("advice"))


ZONES_SQL = "SELECT * FROM (VALUES " + ", ".join(
    "('" + z.replace("'", "''") + f"', {la}, {lo})" for z, la, lo in constants.PREDEFINED_ZONES) + ") AS z(zone, latitude, longitude)"


@register("inline_zones", A.with_views(f"""
SELECT z.zone, n.sid AS air_id, round(1e-9 + n.d, 6) AS air_distance_km,
       round(1e-9 + {X.pollution('n.pm25', 'n.no2', 'n.aqi')}, 6) AS pollution_score
FROM z LEFT JOIN (
  SELECT zone, sid, d, pm25, no2, aqi FROM (
    SELECT z.zone, s.station_id AS sid, {X.haversine('z.latitude', 'z.longitude', 's.latitude', 's.longitude')} AS d,
           s.pm25, s.no2, s.aqi,
           row_number() OVER (PARTITION BY z.zone ORDER BY {X.haversine('z.latitude', 'z.longitude', 's.latitude', 's.longitude')}, s.station_id) AS rn
    FROM z, air_latest s) WHERE rn = 1) n ON n.zone = z.zone""", **{**SCORING_VIEWS, "z": ZONES_SQL}))
def q_inline_zones(spark, d):
    """Named zones (inline constant table) -> nearest station and its pollution score."""
    air = scoring.materialize(snapshots.latest_air(A.air_raw(spark, d), AS_OF)).withColumnRenamed("station_id", "sensor_id")
    z = spatial.nearest(constants.zones(spark), air, ["zone"], payload=["pm25", "no2", "aqi"], prefix="air_")
    return z.select("zone", "air_id", r6("air_distance_km").alias("air_distance_km"),
                    r6(fs.pollution_score("air_pm25", "air_no2", "air_aqi")).alias("pollution_score"))


WEATHER_POINTS_SQL = "SELECT * FROM (VALUES " + ", ".join(
    f"('{i}', {la}, {lo})" for i, _, la, lo in constants.DEFAULT_WEATHER_POINTS) + ") AS z(point_id, latitude, longitude)"


@register("inline_weather_points", A.with_views(f"""
SELECT point_id, air_id, round(1e-9 + air_km, 6) AS air_distance_km, wx_id, round(1e-9 + wx_km, 6) AS wx_distance_km FROM (
  SELECT z.point_id, s.station_id AS air_id, {X.haversine('z.latitude', 'z.longitude', 's.latitude', 's.longitude')} AS air_km,
         row_number() OVER (PARTITION BY z.point_id ORDER BY {X.haversine('z.latitude', 'z.longitude', 's.latitude', 's.longitude')}, s.station_id) AS rn
  FROM z, air_latest s) a JOIN (
  SELECT z.point_id, w.point_id AS wx_id, {X.haversine('z.latitude', 'z.longitude', 'w.latitude', 'w.longitude')} AS wx_km,
         row_number() OVER (PARTITION BY z.point_id ORDER BY {X.haversine('z.latitude', 'z.longitude', 'w.latitude', 'w.longitude')}, w.point_id) AS rn
  FROM z, wx_latest w) b USING (point_id) WHERE a.rn = 1 AND b.rn = 1""", **{**SCORING_VIEWS, "z": WEATHER_POINTS_SQL}))
def q_inline_weather_points(spark, d):
    """Configured weather points (inline constant table) -> nearest air station and nearest observed point."""
    air = scoring.materialize(snapshots.latest_air(A.air_raw(spark, d), AS_OF)).withColumnRenamed("station_id", "sensor_id")
    wx = scoring.materialize(snapshots.latest_weather(A.weather_raw(spark, d), AS_OF)).withColumnRenamed("point_id", "sensor_id")
    points = constants.weather_points(spark).select("point_id", "latitude", "longitude")
    near = spatial.nearest(points, air, ["point_id"], payload=[], prefix="air_").select("point_id", "air_id", "air_distance_km")
    near_wx = spatial.nearest(points, wx, ["point_id"], payload=[], prefix="wx_").select("point_id", "wx_id", "wx_distance_km")
    both = near.join(near_wx, "point_id")
    return both.select("point_id", "air_id", r6("air_distance_km").alias("air_distance_km"), "wx_id", r6("wx_distance_km").alias("wx_distance_km"))


def _coverage_sql(listed: list[str], table: str, key: str, ts: str) -> str:
    ids = ", ".join(f"('{x}')" for x in listed)
    return A.with_views(f"""
SELECT l.{key}, count(f.{key}) AS n_rows, max(f.{ts}) AS latest FROM (VALUES {ids}) AS l({key}) LEFT JOIN {table} f ON f.{key} = l.{key}
GROUP BY l.{key}
UNION ALL SELECT NULL, count(*), max({ts}) FROM {table} f WHERE NOT EXISTS (SELECT 1 FROM (VALUES {ids}) AS l({key}) WHERE l.{key} = f.{key})""",
                        **views(table))


@register("inline_air_stations", _coverage_sql(constants.DEFAULT_AIR_STATIONS, "air", "station_id", "measured_at"))
def q_inline_air_stations(spark, d):
    """Rows and latest time of every polled air station (inline constant table), and of all others together."""
    return dashboard.poll_coverage(A.air_raw(spark, d), constants.air_stations(spark), "station_id", "measured_at")


@register("inline_stops", _coverage_sql(constants.DEFAULT_STOPS, "stop_visits", "stop_id", "recorded_at"))
def q_inline_stops(spark, d):
    """Rows and latest time of every monitored stop (inline constant table), and of all others together."""
    return dashboard.poll_coverage(visits(spark, d), constants.stops(spark), "stop_id", "recorded_at")

"""Registered queries: assistant-layer text operators over question tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from metroscope.functions import formats as fm
from metroscope.functions import text as tx
from metroscope.operators import assistant, delays, scoring, snapshots
from metroscope.operators.common import stored_copy
from metroscope.plans import adapters as A
from metroscope.plans.q_scoring import SCORING_VIEWS
from metroscope.plans.queries import AS_OF_SQL, r6, register, sql_r6, views, visits

AS_OF = A.AS_OF
# Terms searched in the invented question texts: the reference's zone list
# first (it names places the texts do not contain), then words that occur.
QUERY_ZONES = tx.ZONE_NAMES + ["la", "der", "the"]
# Line patterns: the reference's, then two that occur in the texts (ASCII
# captures only: engines upper-case some letters differently).
QUERY_LINE_PATTERNS = tx.LINE_PATTERNS + [
    (r"(?:^|\s)THE\s+([A-Z]{3,})(?:[\s.,;!?]|$)", "THE {}"),
    (r"(?:^|\s)LA\s+([A-Z]{3,})(?:[\s.,;!?]|$)", "LA {}"),
]


def _questions(spark, d):
    c = A.table(spark, d, "conversations")
    return c.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("question"))


SQL_QUESTIONS = "SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user'"


def _sql_zone(col: str, zones) -> str:
    arms = " ".join(f"WHEN contains(lower({col}), '{z}') THEN '{z}'" for z in zones)
    return f"(CASE {arms} END)"


def _sql_line(col: str, patterns) -> str:
    arms = []
    for rx, tmpl in patterns:
        pre, _, post = tmpl.partition("{}")
        arms.append(f"WHEN regexp_matches(upper({col}), '{rx}') THEN '{pre}' || "
                    f"regexp_extract(upper({col}), '{rx}', 1) || '{post}'")
    return f"(CASE {' '.join(arms)} END)"


@register("extract_zone", A.with_views(f"SELECT conv_id, turn, {_sql_zone('question', QUERY_ZONES)} AS zone FROM q",
                                       q=SQL_QUESTIONS))
def q_extract_zone(spark, d):
    """First zone term (in list order) contained in each question."""
    return _questions(spark, d).select("conv_id", "turn", tx.extract_zone("question", QUERY_ZONES).alias("zone"))


@register("extract_line", A.with_views(f"SELECT conv_id, turn, {_sql_line('question', QUERY_LINE_PATTERNS)} AS line "
                                       f"FROM q", q=SQL_QUESTIONS))
def q_extract_line(spark, d):
    """Line mention of each question by pattern priority."""
    return _questions(spark, d).select("conv_id", "turn", tx.extract_line("question", QUERY_LINE_PATTERNS).alias("line"))


def _intent_k_sql() -> str:
    return _pick_sql("(conv_id + turn) % 8", tx.INTENTS)


def _pick_sql(idx, values):
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {idx} {arms} END)"


def _replies(spark, d):
    """Classifier replies (stand-in input): fenced, plain, unknown-intent,
    prose, language-less and array replies, by turn."""
    c = A.table(spark, d, "conversations")
    ik = None
    for i, v in enumerate(tx.INTENTS):
        cond = (F.col("conv_id") + F.col("turn")) % 8 == i
        ik = F.when(cond, F.lit(v)) if ik is None else ik.when(cond, F.lit(v))
    lk = (F.when(F.col("conv_id") % 3 == 0, F.lit("de")).when(F.col("role") == "user", F.lit("fr")).otherwise(F.lit("en")))
    body = F.concat(F.lit('{"intent": "'), ik, F.lit('", "language": "'), lk, F.lit('"}'))
    t = F.col("turn") % 6
    reply = (F.when(t == 0, F.concat(F.lit("```json\n"), body, F.lit("```")))
             .when(t == 1, body)
             .when(t == 2, F.concat(F.lit('  {"intent": "unknown_'), ik, F.lit('", "language": "en"}  ')))
             .when(t == 3, F.col("text"))
             .when(t == 4, F.concat(F.lit('{"intent": "'), ik, F.lit('"}')))
             .otherwise(F.lit('["weather"]')))
    return c.select("conv_id", "turn", reply.alias("reply"))


SQL_INTENTS = f"""
SELECT conv_id, turn,
       CASE WHEN turn % 6 IN (0, 1, 4) THEN {_intent_k_sql()} ELSE 'general_knowledge' END AS intent,
       CASE WHEN turn % 6 IN (0, 1) AND conv_id % 3 <> 0 THEN (CASE WHEN role = 'user' THEN 'fr' ELSE 'en' END)
            WHEN turn % 6 = 2 THEN 'en' ELSE 'fr' END AS language
FROM conversations"""


def _intents(spark, d):
    r = _replies(spark, d)
    intent, lang = tx.normalize_intent("reply")
    return r.select("conv_id", "turn", intent.alias("intent"), lang.alias("language"))


@register("normalize_intent", A.with_views("SELECT * FROM i", i=SQL_INTENTS))
def q_normalize_intent(spark, d):
    """Classifier replies -> (intent, language) with the fallbacks."""
    return _intents(spark, d)


SQL_ROUTES = "SELECT * FROM (VALUES " + ", ".join(
    f"('{k}', {('NULL' if t is None else repr(t))})" for k, ts in tx.INTENT_TOOLS.items() for t in (ts or [None])
) + ") AS r(intent, tool)"


@register("route_tools", A.with_views("SELECT i.conv_id, i.turn, i.intent, r.tool FROM i LEFT JOIN r USING (intent)",
                                      i=SQL_INTENTS, r=SQL_ROUTES))
def q_route_tools(spark, d):
    """Tools called for each classified question."""
    return assistant.route_tools(_intents(spark, d)).select("conv_id", "turn", "intent", "tool")


SQL_AIR6 = SCORING_VIEWS["air_latest"]


@register("score10_air", A.with_views(f"""
SELECT station_id, aqi,
       CASE WHEN aqi IS NULL THEN NULL {" ".join(f"WHEN aqi <= {ub} THEN {lo}" for ub, lo, _ in tx.AIR_BANDS_10)} ELSE 1 END AS score_low,
       CASE WHEN aqi IS NULL THEN NULL {" ".join(f"WHEN aqi <= {ub} THEN {hi}" for ub, _, hi in tx.AIR_BANDS_10)} ELSE 1 END AS score_high
FROM air_latest""", **SCORING_VIEWS))
def q_score10_air(spark, d):
    """AQI -> /10 band of every station of the 6 h snapshot."""
    s = snapshots.latest_air(A.air_raw(spark, d), AS_OF)
    lo, hi = tx.air_score10("aqi")
    return s.select("station_id", "aqi", lo.alias("score_low"), hi.alias("score_high"))


@register("score10_air_mean", A.with_views(f"""
SELECT {sql_r6('m')} AS mean_aqi,
       CASE WHEN m IS NULL THEN NULL {" ".join(f"WHEN m <= {ub} THEN {lo}" for ub, lo, _ in tx.AIR_BANDS_10)} ELSE 1 END AS score_low,
       CASE WHEN m IS NULL THEN NULL {" ".join(f"WHEN m <= {ub} THEN {hi}" for ub, _, hi in tx.AIR_BANDS_10)} ELSE 1 END AS score_high,
       CASE {" ".join(f"WHEN (CASE WHEN m IS NULL THEN NULL {' '.join(f'WHEN m <= {ub} THEN {lo}' for ub, lo, _ in tx.AIR_BANDS_10)} ELSE 1 END) >= {f} THEN '{t.replace(chr(39), chr(39) * 2)}'" for f, t in tx.AIR_ADVICE_10)} END AS advice
FROM (SELECT avg(aqi) AS m FROM air_latest)""", **SCORING_VIEWS))
def q_score10_air_mean(spark, d):
    """Mean AQI over stations -> /10 band and advice."""
    s = snapshots.latest_air(A.air_raw(spark, d), AS_OF).agg(F.avg("aqi").alias("m"))
    lo, hi = tx.air_score10("m")
    return s.select(r6("m").alias("mean_aqi"), lo.alias("score_low"), hi.alias("score_high"),
                    tx.air_advice10(lo).alias("advice"))


@register("score10_traffic", A.with_views(f"""
SELECT line_id, {sql_r6('avg_d')} AS avg_delay,
       CASE WHEN avg_d IS NULL THEN NULL {" ".join(f"WHEN avg_d < {ub} THEN {sc}" for ub, sc in tx.TRAFFIC_BANDS_10)} ELSE 2 END AS score10
FROM (SELECT line_id, avg(CAST(delay_seconds AS DOUBLE)) AS avg_d FROM stop_visits
      WHERE recorded_at >= {AS_OF_SQL} - INTERVAL 24 HOUR GROUP BY line_id)""", **views("stop_visits")))
def q_score10_traffic(spark, d):
    """Mean stored delay per line (24 h) -> /10 score."""
    v = snapshots.trailing(visits(spark, d), "recorded_at", AS_OF, hours=24)
    g = v.groupBy("line_id").agg(F.avg(F.col("delay_seconds").cast("double")).alias("avg_d"))
    return g.select("line_id", r6("avg_d").alias("avg_delay"), tx.traffic_score10("avg_d").alias("score10"))


# ---------------------------------------------------------------- fact blocks
def _age_short_sql(col: str) -> str:
    m = f"((epoch_us({AS_OF_SQL}) - epoch_us({col})) // 60000000)"
    return f"(CASE WHEN {m} < 60 THEN 'il y a ' || CAST({m} AS VARCHAR) || ' min' ELSE 'il y a ' || CAST({m} // 60 AS VARCHAR) || 'h' END)"


def _zones(spark, d):
    z = _questions(spark, d).select(tx.extract_zone("question", QUERY_ZONES).alias("zone")).filter(F.col("zone").isNotNull())
    return z.unionByName(spark.range(1).select(F.lit(None).cast("string").alias("zone")))


SQL_ZONES = f"""SELECT DISTINCT {_sql_zone('question', QUERY_ZONES)} AS zone FROM ({SQL_QUESTIONS})
                WHERE {_sql_zone('question', QUERY_ZONES)} IS NOT NULL UNION ALL SELECT NULL"""
_AIR_LINE = (f"'  - ' || station_name || ' : ' || concat_ws(', ', 'AQI=' || CASE WHEN coalesce(aqi, 0) = 0 THEN '?' "
             f"ELSE CAST(aqi AS VARCHAR) END, CASE WHEN pm25 IS NOT NULL THEN 'PM2.5=' || printf('%.0f', pm25) || ' µg/m³' END, "
             f"CASE WHEN pm10 IS NOT NULL THEN 'PM10=' || printf('%.0f', pm10) || ' µg/m³' END, "
             f"CASE WHEN no2 IS NOT NULL THEN 'NO2=' || printf('%.0f', no2) || ' µg/m³' END) || ' (source: ' || "
             f"coalesce(attribution, 'AQICN') || ', mesuré ' || {_age_short_sql('measured_at')} || ')'")
SQL_AIR6_FULL = f"""
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY measured_at DESC) AS rn
               FROM air WHERE measured_at >= {AS_OF_SQL} - INTERVAL 6 HOUR) WHERE rn = 1"""


@register("fact_block_air", A.with_views(f"""
SELECT zone, CAST(row_number() OVER (PARTITION BY zone ORDER BY station_id) AS INTEGER) AS line_no, {_AIR_LINE} AS text
FROM m
UNION ALL SELECT zone, 0, '{assistant.AIR_HEADER.replace("'", "''")}' FROM n WHERE cnt > 0
UNION ALL SELECT zone, CAST(cnt + 1 AS INTEGER), '' FROM n WHERE cnt > 0
UNION ALL SELECT zone, CAST(cnt + 2 AS INTEGER), '{assistant.AIR_GUIDE}' FROM n WHERE cnt > 0
UNION ALL SELECT zone, 0, CASE WHEN zone IS NULL OR (SELECT count(*) FROM s) = 0
                          THEN '{assistant.AIR_NONE.replace("'", "''")}'
                          ELSE '[NO_DATA] Aucune mesure récente pour la zone ''' || zone || '''.' END FROM n WHERE cnt = 0""",
    air=A.SQL_AIR, s=SQL_AIR6_FULL, z=SQL_ZONES,
    m="""SELECT z.zone, s.* FROM z JOIN s ON z.zone IS NULL OR contains(lower(coalesce(s.station_name, '')), lower(z.zone))""",
    n="SELECT z.zone, (SELECT count(*) FROM m WHERE m.zone IS NOT DISTINCT FROM z.zone) AS cnt FROM z"))
def q_fact_block_air(spark, d):
    """Air fact text (numbered lines) for every zone the questions mention, and for all stations."""
    s = snapshots.latest_air(A.air_raw(spark, d), AS_OF, cols=["station_id", "station_name", "latitude", "longitude",
                                                               "aqi", "pm25", "pm10", "no2", "measured_at", "attribution"])
    return assistant.fact_block_air(s, _zones(spark, d), AS_OF)


_WX_LINE = (f"'  - ' || point_name || ' : ' || concat_ws(', ', CASE WHEN temperature_c IS NOT NULL THEN printf('%.1f', temperature_c) || '°C' END, "
            f"CASE WHEN humidity_pct IS NOT NULL THEN 'humidité ' || printf('%.0f', humidity_pct) || '%' END, "
            f"CASE WHEN precipitation_mm > 0 THEN 'pluie ' || printf('%.1f', precipitation_mm) || 'mm' "
            f"WHEN precipitation_mm IS NOT NULL THEN 'pas de pluie' END, "
            f"CASE WHEN wind_speed_ms IS NOT NULL THEN 'vent ' || printf('%.1f', wind_speed_ms) || ' m/s' END) || "
            f"' (source: Open-Meteo, observé ' || {_age_short_sql('observed_at')} || ')'")
SQL_POINTS = f"SELECT zone AS point FROM ({SQL_ZONES})"


def _points(spark, d):
    # as in the reference, the weather tool is asked with the zone extracted from each question
    return _zones(spark, d).select(F.col("zone").alias("point"))


@register("fact_block_weather", A.with_views(f"""
SELECT point, CAST(row_number() OVER (PARTITION BY point ORDER BY point_id) AS INTEGER) AS line_no, {_WX_LINE} AS text FROM m
UNION ALL SELECT point, 0, '{assistant.WX_HEADER}' FROM n WHERE cnt > 0
UNION ALL SELECT point, 0, CASE WHEN point IS NULL OR (SELECT count(*) FROM s) = 0 THEN '{assistant.WX_NONE}'
                           ELSE '[NO_DATA] Aucune observation pour ''' || point || '''.' END FROM n WHERE cnt = 0""",
    weather=A.SQL_WEATHER, p=SQL_POINTS,
    s=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY observed_at DESC) AS rn
          FROM weather WHERE observed_at >= {AS_OF_SQL} - INTERVAL 3 HOUR) WHERE rn = 1""",
    m="""SELECT p.point, s.* FROM p JOIN s ON p.point IS NULL OR contains(lower(coalesce(s.point_name, '')), lower(p.point))
         OR contains(lower(coalesce(s.point_id, '')), lower(p.point))""",
    n="SELECT p.point, (SELECT count(*) FROM m WHERE m.point IS NOT DISTINCT FROM p.point) AS cnt FROM p"))
def q_fact_block_weather(spark, d):
    """Weather fact text (numbered lines) for the zones the questions mention, and for all points."""
    s = snapshots.latest_weather(A.weather_raw(spark, d), AS_OF, cols=[
        "point_id", "point_name", "latitude", "longitude", "temperature_c", "humidity_pct", "precipitation_mm",
        "wind_speed_ms", "uv_index", "observed_at"])
    return assistant.fact_block_weather(s, _points(spark, d), AS_OF)


# ---------------------------------------------------------------- summaries
def _gc_sql(g: str) -> str:
    return "(CASE " + " ".join(f"WHEN {g} = '{k}' THEN '{v}'" for k, v in fm.GRADE_COLORS_SERVICE.items()) + " END)"


def _tot(ps="ps", ws="ws", ts="ts"):
    from metroscope.plans import sql_exprs as X
    return X.total(ps, ws, ts)


def _grade(e):
    from metroscope.plans import sql_exprs as X
    return X.grade(e)


SQL_SUMMARY_BASE = f"""
SELECT journey_id, journey_label, comparison_id, input_pos, warnings_text,
       {sql_r6(_tot())} AS o, {sql_r6('ps')} AS p, {sql_r6('ws')} AS w, {sql_r6('ts')} AS t, {_grade(_tot())} AS grade
FROM journey_agg"""


@register("journey_summary", A.with_views(f"""
SELECT journey_id, 0 AS line_no, 'Score santé' AS k, '[DATA] Score santé du trajet ''' || journey_label || ''' :' AS text FROM b
UNION ALL SELECT journey_id, 1, 'g', '  Grade ' || grade || ' (' || printf('%.0f', o) || '/100, couleur ' || {_gc_sql('grade')} || ')' FROM b
UNION ALL SELECT journey_id, 2, 'p', '  Pollution : ' || printf('%.0f', p) || '/100' FROM b
UNION ALL SELECT journey_id, 3, 'w', '  Météo     : ' || printf('%.0f', w) || '/100' FROM b
UNION ALL SELECT journey_id, 4, 't', '  Trafic    : ' || printf('%.0f', t) || '/100' FROM b
UNION ALL SELECT journey_id, 5, 'l', '  Limites :' FROM b WHERE warnings_text <> ''
UNION ALL SELECT journey_id, CAST(5 + i AS INTEGER), 'x', '    ⚠️ ' || wtxt FROM (
  SELECT journey_id, unnest(string_split(warnings_text, ' | ')) AS wtxt,
         generate_subscripts(string_split(warnings_text, ' | '), 1) AS i FROM b WHERE warnings_text <> '')""",
    **{**SCORING_VIEWS, "b": SQL_SUMMARY_BASE}).replace(", 'Score santé' AS k", "").replace(", 'g'", "").replace(
    ", 'p'", "").replace(", 'w'", "").replace(", 't'", "").replace(", 'l'", "").replace(", 'x'", ""))
def q_journey_summary(spark, d):
    """Per-journey summary text lines (grade, colour, sub-scores, warnings)."""
    from metroscope.plans.q_scoring import _scored
    s = _scored(spark, d)
    for c in ("overall_score", "pollution_score", "weather_score", "traffic_score"):
        s = s.withColumn(c, r6(c))
    return assistant.journey_summary_lines(s).withColumn("line_no", F.col("line_no").cast("int"))


@register("comparison_summary", A.with_views(f"""
SELECT comparison_id, 0 AS line_no, '{assistant.COMPARE_HEADER}' AS text FROM c WHERE n >= 2
UNION ALL SELECT comparison_id, 0, '{assistant.COMPARE_TOO_FEW}' FROM c WHERE n < 2
UNION ALL SELECT r.comparison_id, CAST(r.rnk AS INTEGER), '  ' || CAST(r.rnk AS VARCHAR) || '. ' || r.journey_label || ' : ' ||
       r.grade || ' (' || printf('%.0f', r.o) || '/100)' || CASE WHEN r.journey_id = c.best THEN ' (recommandé)' ELSE '' END
FROM r JOIN c USING (comparison_id) WHERE c.n >= 2
UNION ALL SELECT comparison_id, CAST(n + 1 AS INTEGER), CASE WHEN gap >= 5.0
       THEN '  → Différence significative (' || printf('%.0f', gap) || ' pts d''écart).'
       ELSE '  → Différence minime (' || printf('%.0f', gap) || ' pts), trajets équivalents.' END FROM c WHERE n >= 2""",
    **{**SCORING_VIEWS, "b": SQL_SUMMARY_BASE},
    r="SELECT *, row_number() OVER (PARTITION BY comparison_id ORDER BY tot DESC, input_pos) AS rnk FROM "
      f"(SELECT b.*, ja.tot FROM b JOIN (SELECT journey_id, {_tot()} AS tot FROM journey_agg) ja USING (journey_id))",
    c=f"""SELECT comparison_id, count(*) AS n, arg_max(journey_id, (tot, -input_pos)) AS best,
                 {sql_r6('max(tot) - min(tot)')} AS gap
          FROM (SELECT *, {_tot()} AS tot FROM journey_agg) GROUP BY comparison_id"""))
def q_comparison_summary(spark, d):
    """Per-comparison text lines: ranked journeys, recommended one, significance."""
    from metroscope.plans.q_scoring import _scored
    s = stored_copy(_scored(spark, d), "scored")  # scored once: the comparison, the ranks and the texts read the copy
    cmp_ = scoring.compare_journeys(s).withColumn("score_gap", r6("score_gap"))
    ranked = scoring.rank_journeys(s).withColumn("overall_score", r6("overall_score"))
    return assistant.comparison_summary_lines(cmp_, ranked)


# ---------------------------------------------------------------- traffic facts
SQL_TRAFFIC_NAMES = (f"SELECT upper(p_brand) AS name FROM part UNION SELECT line FROM (SELECT "
                     f"{_sql_line('question', QUERY_LINE_PATTERNS)} AS line FROM ({SQL_QUESTIONS})) WHERE line IS NOT NULL")
SQL_RECENT = f"SELECT * FROM stop_visits WHERE recorded_at >= {AS_OF_SQL} - INTERVAL 2 HOUR AND delay_seconds IS NOT NULL"
TRAFFIC_VIEWS = {
    **views("stop_visits", "lines"), "names": SQL_TRAFFIC_NAMES, "recent": SQL_RECENT,
    "pairs": """SELECT n.name, l.line_id, l.short_name, l.transport_mode, l.network_name
                FROM names n LEFT JOIN lines l ON lower(n.name) = lower(l.short_name)""",
    "facts": f"""
SELECT i.name, CASE
  WHEN i.line_id IS NULL THEN '[NO_DATA] Aucune ligne nommée ''' || i.name || ''' trouvée dans le référentiel IDFM. Essayez avec le nom court exact (ex: ''T2'', ''RER A'', ''258'').'
  WHEN st.n IS NULL THEN '[NO_DATA] Aucune mesure récente pour la ligne ' || i.short_name || ' sur les 2 dernières heures.'
  ELSE '[DATA] Ligne ' || i.short_name || ' (' || coalesce(nullif(i.transport_mode, ''), '?') || ', ' || coalesce(nullif(i.network_name, ''), '?') || ') : ' ||
       CAST(st.n AS VARCHAR) || ' passages observés sur les 2 dernières heures, retard moyen ' || printf('%.1f', st.a / 60.0) ||
       ' min (source: PRIM IDFM, dernier ' || {_age_short_sql('st.latest')} || ').' END AS text
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY line_id) AS rn FROM pairs) WHERE rn = 1) i
LEFT JOIN (SELECT p.name, count(*) AS n, avg(CAST(v.delay_seconds AS DOUBLE)) AS a, max(v.recorded_at) AS latest
           FROM recent v JOIN pairs p ON p.line_id = v.line_id GROUP BY p.name) st ON st.name = i.name
UNION ALL
SELECT NULL, CASE WHEN count(*) = 0 THEN '[NO_DATA] Aucun passage capté sur les 2 dernières heures.'
  ELSE '[DATA] Vue d''ensemble du trafic IDF (2 dernières heures) : ' || CAST(count(*) AS VARCHAR) || ' passages observés sur ' ||
       CAST(count(DISTINCT line_id) AS VARCHAR) || ' lignes distinctes, retard moyen ' || printf('%.0f', avg(CAST(delay_seconds AS DOUBLE))) ||
       ' secondes (source: PRIM IDFM, dernier ' || {_age_short_sql('max(recorded_at)')} || ').' END FROM recent""",
}


def _traffic_facts(spark, d):
    asked = _questions(spark, d).select(tx.extract_line("question", QUERY_LINE_PATTERNS).alias("name")).filter("name IS NOT NULL")
    names = asked.unionByName(A.table(spark, d, "part").select(F.upper("p_brand").alias("name")))
    v = visits(spark, d)
    return assistant.fact_block_traffic(delays.line_stats(v, A.lines(spark, d), names, AS_OF), delays.traffic_overview(v, AS_OF), AS_OF)


@register("fact_block_traffic", A.with_views("SELECT name, text FROM facts", **TRAFFIC_VIEWS))
def q_fact_block_traffic(spark, d):
    """Traffic fact text for every line the questions mention or the reference lists, and for the network."""
    return _traffic_facts(spark, d)


_SQL_ASKED_ZONE = _sql_zone("q.question", QUERY_ZONES)


@register("has_real_data", A.with_views(f"""
SELECT i.conv_id, i.turn, i.intent,
       coalesce(bool_or(CASE r.tool WHEN 'list_capabilities' THEN true WHEN 'get_current_air_quality' THEN az.has_data
                        WHEN 'get_current_weather' THEN wz.has_data WHEN 'get_current_traffic' THEN starts_with(f.text, '[DATA]')
                        ELSE false END), false) AS has_real_data
FROM i LEFT JOIN r USING (intent)
LEFT JOIN q ON q.conv_id = i.conv_id AND q.turn = i.turn
LEFT JOIN az ON az.zone IS NOT DISTINCT FROM (CASE WHEN i.intent = 'air_quality' THEN {_SQL_ASKED_ZONE} END)
LEFT JOIN wz ON wz.zone IS NOT DISTINCT FROM {_SQL_ASKED_ZONE}
LEFT JOIN facts f ON f.name IS NOT DISTINCT FROM {_sql_line('q.question', QUERY_LINE_PATTERNS)}
GROUP BY i.conv_id, i.turn, i.intent""",
    i=SQL_INTENTS + " WHERE role = 'user'", r=SQL_ROUTES, q=SQL_QUESTIONS, air=A.SQL_AIR, s=SQL_AIR6_FULL,
    az=f"""SELECT z.zone, count(s.station_id) > 0 AS has_data FROM ({SQL_ZONES}) z
           LEFT JOIN s ON z.zone IS NULL OR contains(lower(coalesce(s.station_name, '')), lower(z.zone)) GROUP BY z.zone""",
    weather=A.SQL_WEATHER,
    ws=f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY observed_at DESC) AS rn
           FROM weather WHERE observed_at >= {AS_OF_SQL} - INTERVAL 3 HOUR) WHERE rn = 1""",
    wz=f"""SELECT z.zone, count(ws.point_id) > 0 AS has_data FROM ({SQL_ZONES}) z
           LEFT JOIN ws ON z.zone IS NULL OR contains(lower(coalesce(ws.point_name, '')), lower(z.zone))
             OR contains(lower(coalesce(ws.point_id, '')), lower(z.zone)) GROUP BY z.zone""",
    **TRAFFIC_VIEWS))
def q_has_real_data(spark, d):
    """Per user question: does any gathered context carry real data?

    Contexts come from all routed tools: the capabilities text; the air and
    weather blocks of the zone asked for (journey questions ask for all
    stations); the traffic text of the line asked for, or of the network; the
    guide text, which is no data."""
    questions = _questions(spark, d)
    it = _intents(spark, d).join(questions.select("conv_id", "turn"), ["conv_id", "turn"])
    asked = questions.select("conv_id", "turn", tx.extract_zone("question", QUERY_ZONES).alias("asked_zone"),
                             tx.extract_line("question", QUERY_LINE_PATTERNS).alias("asked_line"))
    routed = assistant.route_tools(it).join(asked, ["conv_id", "turn"], "left")
    routed = routed.withColumn("air_zone", F.when(F.col("intent") == "air_quality", F.col("asked_zone")))
    air = snapshots.latest_air(A.air_raw(spark, d), AS_OF, cols=["station_id", "station_name", "latitude", "longitude", "aqi",
                                                                 "pm25", "pm10", "no2", "measured_at", "attribution"])
    wx = snapshots.latest_weather(A.weather_raw(spark, d), AS_OF, cols=[
        "point_id", "point_name", "latitude", "longitude", "temperature_c", "humidity_pct", "precipitation_mm",
        "wind_speed_ms", "uv_index", "observed_at"])
    first = lambda block, key, out: block.filter("line_no = 0").select(F.col(key).alias(f"{out}_key"), F.col("text").alias(out))
    heads = [(first(assistant.fact_block_air(air, _zones(spark, d), AS_OF), "zone", "air_text"), "air_zone"),
             (first(assistant.fact_block_weather(wx, _points(spark, d), AS_OF), "point", "wx_text"), "asked_zone"),
             (_traffic_facts(spark, d).select(F.col("name").alias("traffic_text_key"), F.col("text").alias("traffic_text")), "asked_line")]
    for facts, key in heads:
        routed = routed.join(facts, F.col(key).eqNullSafe(F.col(facts.columns[0])), "left")
    ctx = (F.when(F.col("tool") == "list_capabilities", F.lit("[DATA] Capacités"))
           .when(F.col("tool") == "get_current_air_quality", F.col("air_text"))
           .when(F.col("tool") == "get_current_weather", F.col("wx_text"))
           .when(F.col("tool") == "get_current_traffic", F.col("traffic_text")))
    g = routed.groupBy("conv_id", "turn", "intent").agg(F.collect_list(ctx).alias("contexts"))
    return g.select("conv_id", "turn", "intent", tx.has_real_data("contexts").alias("has_real_data"))

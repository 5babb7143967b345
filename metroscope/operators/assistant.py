"""Data work of the assistant layer, as batch jobs over question tables.

Text answers are produced as numbered lines ``(key, line_no, text)`` rather
than one concatenated string per key, so a key with very many rows never
has to be gathered into a single value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.functions import formats as fm
from metroscope.functions import text as tx
from metroscope.operators.ranking import rank_within
from metroscope.operators.snapshots import as_of_value
from metroscope.operators.substrings import matches

# Answer texts.
AIR_HEADER = "[DATA] Qualité de l'air actuelle :"
AIR_GUIDE = ("[GUIDE] Seuils OMS PM2.5 : ≤5 = excellent, 5-15 = acceptable, 15-25 = modéré, "
             "25-50 = mauvais, >50 = dangereux.")
AIR_NONE = "[NO_DATA] Aucune mesure de qualité de l'air disponible (< 6h)."
AIR_NONE_ZONE = "[NO_DATA] Aucune mesure récente pour la zone '{}'."
WX_HEADER = "[DATA] Météo actuelle :"
WX_NONE = "[NO_DATA] Aucune observation météo disponible (< 3h)."
WX_NONE_POINT = "[NO_DATA] Aucune observation pour '{}'."
TRAFFIC_UNKNOWN = ("[NO_DATA] Aucune ligne nommée '{}' trouvée dans le référentiel IDFM. Essayez avec le nom court exact "
                   "(ex: 'T2', 'RER A', '258').")
TRAFFIC_NONE_LINE = "[NO_DATA] Aucune mesure récente pour la ligne {} sur les 2 dernières heures."
TRAFFIC_LINE = ("[DATA] Ligne {} ({}, {}) : {} passages observés sur les 2 dernières heures, retard moyen {} min "
                "(source: PRIM IDFM, dernier {}).")
TRAFFIC_NONE = "[NO_DATA] Aucun passage capté sur les 2 dernières heures."
TRAFFIC_ALL = ("[DATA] Vue d'ensemble du trafic IDF (2 dernières heures) : {} passages observés sur {} lignes distinctes, "
               "retard moyen {} secondes (source: PRIM IDFM, dernier {}).")
JOURNEY_HEADER = "[DATA] Score santé du trajet '{}' :"
COMPARE_HEADER = "[DATA] Comparaison de trajets :"
COMPARE_TOO_FEW = "[NO_DATA] Il faut au moins 2 trajets à comparer."
BEST_MARKER = " (recommandé)"
WARN_PREFIX = "    ⚠️ "


def _fmt(template: str, *cols):
    parts = template.split("{}")
    out = [F.lit(parts[0])]
    for c, tail in zip(cols, parts[1:]):
        out += [c, F.lit(tail)]
    return F.concat(*out)


def fact_block_air(snapshot: DataFrame, zones: DataFrame, as_of=None) -> DataFrame:
    """Air fact text per requested zone (``zone`` NULL = every station):
    ``(zone, line_no, text)``; stations in id order; no-data texts when the
    snapshot is empty or nothing matches."""
    now = as_of_value(as_of)
    st = snapshot.select("station_id", "station_name", "aqi", "pm25", "pm10", "no2", "measured_at", "attribution")
    z = zones.select("zone").distinct()
    named = matches(z.filter(F.col("zone").isNotNull()), "zone", st, ["station_name"])
    # an all-stations request (NULL zone) keeps every station: a filter on a scalar subquery, no join
    wants_all = z.select(F.count_if(F.col("zone").isNull()) > 0).scalar()
    everyone = st.filter(wants_all).withColumn("zone", F.lit(None).cast("string"))
    matched = named.unionByName(everyone)
    parts = F.concat_ws(", ",
                        F.concat(F.lit("AQI="), F.when(F.coalesce(F.col("aqi"), F.lit(0)) == 0, F.lit("?"))
                                 .otherwise(F.col("aqi").cast("string"))),
                        F.when(F.col("pm25").isNotNull(), _fmt("PM2.5={} µg/m³", fm.fmt_fixed("pm25", 0))),
                        F.when(F.col("pm10").isNotNull(), _fmt("PM10={} µg/m³", fm.fmt_fixed("pm10", 0))),
                        F.when(F.col("no2").isNotNull(), _fmt("NO2={} µg/m³", fm.fmt_fixed("no2", 0))))
    line = _fmt("  - {} : {} (source: {}, mesuré {})", F.col("station_name"), parts,
                F.coalesce(F.col("attribution"), F.lit("AQICN")), fm.format_age_short("measured_at", now))
    body = rank_within(matched.withColumn("text", line).select("zone", "station_id", "text"),
                       ["zone"], [F.col("station_id")], out="line_no").select("zone", "line_no", "text")
    counts = matched.groupBy(F.col("zone").alias("__z")).agg(F.count(F.lit(1)).alias("n"))
    with_n = z.join(counts, F.col("zone").eqNullSafe(F.col("__z")), "left").select(
        "zone", F.coalesce("n", F.lit(0)).alias("n"))
    empty = snapshot.select((F.count(F.lit(1)) == 0).alias("e")).scalar()
    none_text = (F.when(empty, F.lit(AIR_NONE))
                 .when(F.col("zone").isNull(), F.lit(AIR_NONE))
                 .otherwise(_fmt(AIR_NONE_ZONE, F.col("zone"))))
    misses = with_n.filter(F.col("n") == 0).select("zone", F.lit(0).alias("line_no"), none_text.alias("text"))
    hits = with_n.filter(F.col("n") > 0)
    frame = hits.select("zone", F.explode(F.array(
        F.struct(F.lit(0).alias("line_no"), F.lit(AIR_HEADER).alias("text")),
        F.struct((F.col("n") + 1).cast("int").alias("line_no"), F.lit("").alias("text")),
        F.struct((F.col("n") + 2).cast("int").alias("line_no"), F.lit(AIR_GUIDE).alias("text")))).alias("l"))
    frame = frame.select("zone", "l.line_no", "l.text")
    return misses.unionByName(frame).unionByName(body)


def fact_block_weather(snapshot: DataFrame, points: DataFrame, as_of=None) -> DataFrame:
    """Weather fact text per requested point text (name or id contains it;
    NULL = every point): ``(point, line_no, text)``."""
    now = as_of_value(as_of)
    st = snapshot.select("point_id", "point_name", "temperature_c", "humidity_pct", "precipitation_mm",
                         "wind_speed_ms", "observed_at")
    p = points.select("point").distinct()
    named = matches(p.filter(F.col("point").isNotNull()), "point", st, ["point_name", "point_id"])
    wants_all = p.select(F.count_if(F.col("point").isNull()) > 0).scalar()
    everyone = st.filter(wants_all).withColumn("point", F.lit(None).cast("string"))
    matched = named.unionByName(everyone)
    parts = F.concat_ws(", ",
                        F.when(F.col("temperature_c").isNotNull(), _fmt("{}°C", fm.fmt_fixed("temperature_c", 1))),
                        F.when(F.col("humidity_pct").isNotNull(), _fmt("humidité {}%", fm.fmt_fixed("humidity_pct", 0))),
                        F.when(F.col("precipitation_mm") > 0, _fmt("pluie {}mm", fm.fmt_fixed("precipitation_mm", 1)))
                         .when(F.col("precipitation_mm").isNotNull(), F.lit("pas de pluie")),
                        F.when(F.col("wind_speed_ms").isNotNull(), _fmt("vent {} m/s", fm.fmt_fixed("wind_speed_ms", 1))))
    line = _fmt("  - {} : {} (source: Open-Meteo, observé {})", F.col("point_name"), parts,
                fm.format_age_short("observed_at", now))
    body = rank_within(matched.withColumn("text", line).select("point", "point_id", "text"),
                       ["point"], [F.col("point_id")], out="line_no").select("point", "line_no", "text")
    counts = matched.groupBy(F.col("point").alias("__p")).agg(F.count(F.lit(1)).alias("n"))
    with_n = p.join(counts, F.col("point").eqNullSafe(F.col("__p")), "left").select(
        "point", F.coalesce("n", F.lit(0)).alias("n"))
    empty = snapshot.select((F.count(F.lit(1)) == 0).alias("e")).scalar()
    none_text = (F.when(empty | F.col("point").isNull(), F.lit(WX_NONE)).otherwise(_fmt(WX_NONE_POINT, F.col("point"))))
    misses = with_n.filter(F.col("n") == 0).select("point", F.lit(0).alias("line_no"), none_text.alias("text"))
    heads = with_n.filter(F.col("n") > 0).select("point", F.lit(0).alias("line_no"), F.lit(WX_HEADER).alias("text"))
    return misses.unionByName(heads).unionByName(body)


def fact_block_traffic(line_facts: DataFrame, overview: DataFrame, as_of=None) -> DataFrame:
    """Traffic fact text per requested line name, and for the whole network
    (``name`` NULL): ``(name, text)``.

    ``line_facts`` are ``delays.line_stats`` rows, ``overview`` the one row of
    ``delays.traffic_overview``.
    """
    now = as_of_value(as_of)
    text = lambda c, other: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit(other))
    per_line = line_facts.select("name", F.when(~F.col("matched"), _fmt(TRAFFIC_UNKNOWN, F.col("name")))
                                 .when(F.col("samples") == 0, _fmt(TRAFFIC_NONE_LINE, F.col("short_name")))
                                 .otherwise(_fmt(TRAFFIC_LINE, F.col("short_name"), text("transport_mode", "?"),
                                                 text("network_name", "?"), F.col("samples").cast("string"),
                                                 fm.fmt_fixed(F.col("avg_delay") / F.lit(60.0), 1),
                                                 fm.format_age_short("latest", now))).alias("text"))
    whole = overview.select(F.lit(None).cast("string").alias("name"),
                            F.when(F.col("total_samples") == 0, F.lit(TRAFFIC_NONE))
                            .otherwise(_fmt(TRAFFIC_ALL, F.col("total_samples").cast("string"),
                                            F.col("distinct_lines").cast("string"), fm.fmt_fixed("overall_avg_delay", 0),
                                            fm.format_age_short("latest", now))).alias("text"))
    return per_line.unionByName(whole)


def route_tools(intents: DataFrame, intent_col: str = "intent") -> DataFrame:
    """One row per (question, tool) the intent calls; intents calling no tool
    keep one row with a NULL tool."""
    pairs = [(k, t) for k, ts in tx.INTENT_TOOLS.items() for t in (ts or [None])]
    spark = intents.sparkSession
    table = spark.createDataFrame(pairs, "__intent string, tool string")
    return intents.join(F.broadcast(table), F.col(intent_col) == F.col("__intent"), "left").drop("__intent")


def journey_summary_lines(scored: DataFrame, score_cols: dict | None = None) -> DataFrame:
    """Per journey: ``(journey_id, line_no, text)`` summary of grade, scores
    and warnings (scores shown with no decimals)."""
    c = score_cols or {}
    o, p, w, t = (F.col(c.get(k, k)) for k in ("overall_score", "pollution_score", "weather_score", "traffic_score"))
    fixed = F.array(
        F.struct(F.lit(0).alias("line_no"), _fmt(JOURNEY_HEADER, F.col("journey_label")).alias("text")),
        F.struct(F.lit(1).alias("line_no"), _fmt("  Grade {} ({}/100, couleur {})", F.col("grade"), fm.fmt_fixed(o, 0),
                                                 fm.grade_color(F.col("grade"))).alias("text")),
        F.struct(F.lit(2).alias("line_no"), _fmt("  Pollution : {}/100", fm.fmt_fixed(p, 0)).alias("text")),
        F.struct(F.lit(3).alias("line_no"), _fmt("  Météo     : {}/100", fm.fmt_fixed(w, 0)).alias("text")),
        F.struct(F.lit(4).alias("line_no"), _fmt("  Trafic    : {}/100", fm.fmt_fixed(t, 0)).alias("text")))
    warned = F.concat(
        F.array(F.struct(F.lit(5).alias("line_no"), F.lit("  Limites :").alias("text"))),
        F.transform("warnings", lambda w, i: F.struct((i + 6).cast("int").alias("line_no"), F.concat(F.lit(WARN_PREFIX), w).alias("text"))))
    lines = F.when(F.size("warnings") > 0, F.concat(fixed, warned)).otherwise(fixed)
    return scored.select("journey_id", F.explode(lines).alias("l")).select("journey_id", "l.line_no", "l.text")


def comparison_summary_lines(comparison: DataFrame, ranked: DataFrame, group_col: str = "comparison_id",
                             score_col: str = "overall_score", gap_col: str = "score_gap") -> DataFrame:
    """Per comparison: ``(comparison_id, line_no, text)`` — journeys by rank
    with the recommended one marked, then the significance line."""
    cmp_ = comparison.select(group_col, "n_journeys", "best_journey_id", gap_col, "is_significant")
    too_few = cmp_.filter(F.col("n_journeys") < 2).select(group_col, F.lit(0).alias("line_no"),
                                                          F.lit(COMPARE_TOO_FEW).alias("text"))
    ok = cmp_.filter(F.col("n_journeys") >= 2)
    head = ok.select(group_col, F.lit(0).alias("line_no"), F.lit(COMPARE_HEADER).alias("text"))
    r = ranked.join(ok.select(group_col, "best_journey_id"), group_col)
    body = r.select(group_col, F.col("rank").alias("line_no"), _fmt(
        "  {}. {} : {} ({}/100){}", F.col("rank").cast("string"), F.col("journey_label"), F.col("grade"),
        fm.fmt_fixed(score_col, 0),
        F.when(F.col("journey_id") == F.col("best_journey_id"), F.lit(BEST_MARKER)).otherwise(F.lit(""))).alias("text"))
    foot = ok.select(group_col, (F.col("n_journeys") + 1).cast("int").alias("line_no"), F.when(
        F.col("is_significant"), _fmt("  → Différence significative ({} pts d'écart).", fm.fmt_fixed(gap_col, 0)))
        .otherwise(_fmt("  → Différence minime ({} pts), trajets équivalents.", fm.fmt_fixed(gap_col, 0))).alias("text"))
    return too_few.unionByName(head).unionByName(body).unionByName(foot)

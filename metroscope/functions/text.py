"""Question / reply text expressions of the assistant layer.

Mention extraction, classifier-reply normalisation, intent routing and the
/10 bands are plain column expressions so they run over whole question
tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.
# Zone names, in match order (first contained one wins).
ZONE_NAMES = ["paris", "défense", "defense", "saint-denis", "saint denis", "versailles", "créteil",
              "creteil", "boulogne", "vitry", "argenteuil", "cergy", "melun", "aubervilliers"]
# Line mention patterns on the upper-cased question, by priority:
# (regex, output template with {} for capture group 1).
LINE_PATTERNS = [
    (r"\bRER\s*([A-E])\b", "RER {}"),
    (r"\bT\s*([0-9]{1,2}[AB]?)\b", "T{}"),
    (r"\b(?:M[ÉE]TRO|METRO|LIGNE)\s*([0-9]{1,2})\b", "{}"),
]
INTENTS = ["greeting", "help", "air_quality", "weather", "traffic", "journey_score",
           "journey_compare", "general_knowledge"]
LANGUAGES = ["fr", "en"]
DEFAULT_INTENT, DEFAULT_LANGUAGE = "general_knowledge", "fr"
# Intent -> tools called to gather context.
INTENT_TOOLS = {
    "greeting": [],
    "help": ["list_capabilities"],
    "air_quality": ["get_current_air_quality"],
    "weather": ["get_current_weather"],
    "traffic": ["get_current_traffic"],
    "journey_score": ["guide_journey_commands", "get_current_air_quality"],
    "journey_compare": ["guide_journey_commands", "get_current_air_quality"],
    "general_knowledge": [],
}
DATA_MARKER = "[DATA]"
# /10 bands.  Air: AQI upper bound (inclusive) -> (low, high) score.
AIR_BANDS_10 = [(25, 9, 10), (50, 7, 8), (75, 5, 6), (100, 4, 4), (150, 3, 3), (200, 2, 2)]
AIR_TOP_10 = (1, 1)
# Traffic: mean delay upper bound in seconds (exclusive) -> score.
TRAFFIC_BANDS_10 = [(30, 10), (60, 8), (120, 6), (300, 4)]
TRAFFIC_TOP_10 = 2
# Advice by air score band (lowest score of the band -> text).
AIR_ADVICE_10 = [
    (7, "Tu peux sortir/courir/faire du sport sans souci."),
    (5, "Évite le sport intense si tu es sensible (asthme, enfants, personnes âgées)."),
    (3, "Limite les efforts physiques en extérieur."),
    (1, "Reste à l'intérieur, ferme les fenêtres."),
]
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


# White space of any kind (Unicode).
WHITE = (" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009"
         "\u200a\u2028\u2029\u202f\u205f\u3000")


def strip(x) -> Column:
    """The text without white space of any kind at its ends (a bare ``F.trim`` removes spaces only)."""
    return F.trim(_c(x), F.lit(WHITE))


def extract_zone(question, zones: list[str] | None = None) -> Column:
    """First zone of the ordered list contained in the lower-cased text."""
    q = F.lower(_c(question))
    return F.coalesce(*[F.when(q.contains(z), F.lit(z)) for z in (zones or ZONE_NAMES)], F.lit(None).cast("string"))


def _java_regex(p: str) -> str:
    # Word boundaries and classes follow Unicode letters, as in the reference.
    return "(?U)" + p


def extract_line(question, patterns: list[tuple[str, str]] | None = None) -> Column:
    """First line mention by pattern priority, rendered by its template."""
    q = F.upper(_c(question))
    outs = []
    for regex, template in (patterns or LINE_PATTERNS):
        rx = _java_regex(regex)
        pre, _, post = template.partition("{}")
        outs.append(F.when(q.rlike(rx), F.concat(F.lit(pre), F.regexp_extract(q, rx, 1), F.lit(post))))
    return F.coalesce(*outs, F.lit(None).cast("string"))


def clean_reply(reply) -> Column:
    """Strip white space of any kind, surrounding back-ticks and a leading ``json\\n`` tag."""
    t = F.regexp_replace(F.regexp_replace(strip(reply), r"^`+", ""), r"`+$", "")
    return F.when(t.startswith("json\n"), F.substring(t, F.lit(6), F.length(t))).otherwise(t)


def normalize_intent(reply) -> tuple[Column, Column]:
    """Classifier reply -> (intent, language) with the reference fallbacks.

    Unparseable JSON gives (general_knowledge, fr); an unknown intent gives
    general_knowledge; a language outside fr/en gives fr.
    """
    v = F.try_parse_json(clean_reply(reply))
    ok = v.isNotNull() & (F.regexp_extract(F.schema_of_variant(v), r"^([A-Z]+)", 1) == "OBJECT")
    intent_raw = F.coalesce(F.try_variant_get(v, "$.intent", "string"), F.lit(DEFAULT_INTENT))
    lang_raw = F.coalesce(F.try_variant_get(v, "$.language", "string"), F.lit(DEFAULT_LANGUAGE))
    intent = F.when(ok & intent_raw.isin(*INTENTS), intent_raw).otherwise(F.lit(DEFAULT_INTENT))
    lang = F.when(ok & lang_raw.isin(*LANGUAGES), lang_raw).otherwise(F.lit(DEFAULT_LANGUAGE))
    return intent, lang


def has_real_data(contexts) -> Column:
    """True when any context block carries the data marker."""
    return F.coalesce(F.exists(_c(contexts), lambda x: x.contains(DATA_MARKER)), F.lit(False))


def air_score10(aqi) -> tuple[Column, Column]:
    """AQI -> (low, high) /10 score band."""
    a = _c(aqi).cast("double")
    lo = hi = None
    for ub, l, h in AIR_BANDS_10:
        lo = F.when(a <= ub, F.lit(l)) if lo is None else lo.when(a <= ub, F.lit(l))
        hi = F.when(a <= ub, F.lit(h)) if hi is None else hi.when(a <= ub, F.lit(h))
    nul = F.lit(None).cast("int")
    return (F.when(a.isNull(), nul).otherwise(lo.otherwise(F.lit(AIR_TOP_10[0]))),
            F.when(a.isNull(), nul).otherwise(hi.otherwise(F.lit(AIR_TOP_10[1]))))


def traffic_score10(avg_delay_seconds) -> Column:
    d = _c(avg_delay_seconds).cast("double")
    expr = None
    for ub, s in TRAFFIC_BANDS_10:
        expr = F.when(d < ub, F.lit(s)) if expr is None else expr.when(d < ub, F.lit(s))
    return F.when(d.isNull(), F.lit(None).cast("int")).otherwise(expr.otherwise(F.lit(TRAFFIC_TOP_10)))


def air_advice10(score_low) -> Column:
    s = _c(score_low)
    expr = None
    for floor_, text in AIR_ADVICE_10:
        expr = F.when(s >= floor_, F.lit(text)) if expr is None else expr.when(s >= floor_, F.lit(text))
    return expr

"""Categories, colours and display texts (AQI, grades, delays, ages)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values.  AQI upper bounds are inclusive.
AQI_BANDS = [  # (upper bound, category, label, colour)
    (50, "good", "Bon", "#10B981"),
    (100, "moderate", "Modéré", "#F59E0B"),
    (150, "unhealthy_sensitive", "Mauvais (sensibles)", "#F97316"),
    (200, "unhealthy", "Mauvais", "#EF4444"),
    (300, "very_unhealthy", "Très mauvais", "#A855F7"),
]
AQI_TOP = ("hazardous", "Dangereux", "#7C2D12")
AQI_MISSING = ("unknown", "?", "#9CA3AF")
GRADE_COLORS_SERVICE = {"A": "#1B7E3D", "B": "#84BD00", "C": "#FFCD00", "D": "#FF8200", "E": "#E40520"}
GRADE_COLORS_UI = {"A": "#10B981", "B": "#84CC16", "C": "#F59E0B", "D": "#F97316", "E": "#EF4444"}
GRADE_COLOR_UNKNOWN = "#9CA3AF"
ADVICE_BY_GRADE = {
    "A": "🟢 Excellent trajet ! Conditions optimales pour la santé.",
    "B": "🟢 Bon trajet, peu de risques pour la santé.",
    "C": "🟡 Trajet correct, prévoyez un peu plus de temps.",
    "D": "🟠 Conditions dégradées : si vous êtes sensible (asthme, enfants, personnes âgées), "
         "envisagez un autre itinéraire.",
    "E": "🔴 Trajet à éviter si possible. Conditions difficiles (pollution forte, gros retards, météo hostile).",
}
ON_TIME_TEXT = "à l'heure"
JUST_NOW_TEXT = "à l'instant"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _aqi_band(aqi, pick: int) -> Column:
    a = _c(aqi).cast("double")
    expr = F.when(a.isNull(), F.lit(AQI_MISSING[pick - 1]))
    for band in AQI_BANDS:
        expr = expr.when(a <= band[0], F.lit(band[pick]))
    return expr.otherwise(F.lit(AQI_TOP[pick - 1]))


def aqi_category(aqi) -> Column:
    return _aqi_band(aqi, 1)


def aqi_label(aqi) -> Column:
    return _aqi_band(aqi, 2)


def aqi_color(aqi) -> Column:
    return _aqi_band(aqi, 3)


def _lookup(key: Column, mapping: dict, default) -> Column:
    expr = None
    for k, v in mapping.items():
        expr = F.when(key == k, F.lit(v)) if expr is None else expr.when(key == k, F.lit(v))
    return expr.otherwise(F.lit(default))


def grade_color(grade, palette: str = "service") -> Column:
    """Grade colour; the UI palette is case-insensitive with a grey default."""
    if palette == "ui":
        return _lookup(F.upper(_c(grade)), GRADE_COLORS_UI, GRADE_COLOR_UNKNOWN)
    return _lookup(_c(grade), GRADE_COLORS_SERVICE, None)


def grade_advice(grade) -> Column:
    return _lookup(_c(grade), ADVICE_BY_GRADE, None)


def has_precipitation(precipitation_mm="precipitation_mm", rain_mm="rain_mm", snowfall_cm="snowfall_cm") -> Column:
    return (F.coalesce(_c(precipitation_mm) > 0, F.lit(False)) | F.coalesce(_c(rain_mm) > 0, F.lit(False))
            | F.coalesce(_c(snowfall_cm) > 0, F.lit(False)))


def format_delay_minutes(seconds) -> Column:
    """Console form: NULL '?', > 60 '+N min', < -60 'N min' (floor), else on time."""
    s = _c(seconds)
    return (F.when(s.isNull(), F.lit("?"))
            .when(s > 60, F.concat(F.lit("+"), F.floor(s / 60).cast("string"), F.lit(" min")))
            .when(s < -60, F.concat(F.floor(s / 60).cast("string"), F.lit(" min")))
            .otherwise(F.lit(ON_TIME_TEXT)))


def format_delay_clock(seconds) -> Column:
    """UI form: 0 -> '0s'; |s| < 60 -> '±Ns'; else '±Mm Ss' (seconds truncated)."""
    s = _c(seconds).cast("double")
    sign = F.when(s > 0, F.lit("+")).otherwise(F.lit("-"))
    a = F.abs(s.cast("long"))
    return (F.when(s.isNull(), F.lit(None).cast("string"))
            .when(s == 0, F.lit("0s"))
            .when(a < 60, F.concat(sign, a.cast("string"), F.lit("s")))
            .otherwise(F.concat(sign, F.floor(a / 60).cast("string"), F.lit("m "), (a % 60).cast("string"), F.lit("s"))))


def _age_micros(when, as_of) -> Column:
    return F.unix_micros(_c(as_of)) - F.unix_micros(_c(when))


def format_age(when, as_of) -> Column:
    """UI age text relative to ``as_of``: '?', just now, N min, Nh, Nj."""
    d = _age_micros(when, as_of)
    minute, hour, day = 60_000_000, 3_600_000_000, 86_400_000_000
    return (F.when(_c(when).isNull(), F.lit("?"))
            .when(d < minute, F.lit(JUST_NOW_TEXT))
            .when(d < hour, F.concat(F.lit("il y a "), F.floor(d / minute).cast("string"), F.lit(" min")))
            .when(d < day, F.concat(F.lit("il y a "), F.floor(d / hour).cast("string"), F.lit("h")))
            .otherwise(F.concat(F.lit("il y a "), F.floor(d / day).cast("string"), F.lit("j"))))


def format_age_short(when, as_of) -> Column:
    """Fact-block age text: minutes below one hour, else whole hours."""
    d = _age_micros(when, as_of)
    minutes = F.when(d >= 0, F.floor(d / 60_000_000)).otherwise(-F.floor(-d / 60_000_000))
    return (F.when(_c(when).isNull(), F.lit("?"))
            .when(minutes < 60, F.concat(F.lit("il y a "), minutes.cast("string"), F.lit(" min")))
            .otherwise(F.concat(F.lit("il y a "), F.floor(minutes / 60).cast("string"), F.lit("h"))))


def _two_product_err(a: Column, b: float) -> tuple[Column, Column]:
    """p = fl(a*b) and the exact error a*b - p (Dekker; ``b`` has few bits)."""
    p = a * F.lit(b)
    c = a * F.lit(134217729.0)  # 2^27 + 1
    ah = c - (c - a)
    al = a - ah
    return p, (ah * F.lit(b) - p) + al * F.lit(b)


def fmt_fixed(x, digits: int) -> Column:
    """Fixed-point text exactly like Python's ``f"{x:.Nf}"``.

    Python rounds half to even on the EXACT binary value (0.15 -> '0.1');
    Spark's decimal rounding works on the shortest decimal form (-> '0.2').
    The exact rounding error of ``|x| * 10^N`` is recovered with a Dekker
    two-product, which settles the ties.  NULL in -> NULL out.
    """
    v = _c(x).cast("double")
    a = F.abs(v)
    scale = 10.0 ** digits
    p, err = (a, F.lit(0.0)) if digits == 0 else _two_product_err(a, scale)
    fl = F.floor(p)
    frac = p - fl
    up = (F.when(frac > 0.5, True).when(frac < 0.5, False)
          .when(err > 0, True).when(err < 0, False)
          .otherwise(fl % 2 == 1))
    k = (fl + F.when(up, F.lit(1)).otherwise(F.lit(0))).cast("decimal(38,0)")
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        body = k.cast("string")
    else:
        ip = F.floor(k / F.lit(int(scale)))
        fp = k - ip * F.lit(int(scale))
        body = F.concat(ip.cast("string"), F.lit("."), F.lpad(fp.cast("string"), digits, "0"))
    return F.when(v.isNull(), F.lit(None).cast("string")).otherwise(F.concat(sign, body))

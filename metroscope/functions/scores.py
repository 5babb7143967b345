"""Health sub-scores, their weighted combination and the A–E grade.

All functions map columns to a DOUBLE column in 0..100 and reproduce the
reference arithmetic order so results are bit-identical to a scalar
implementation (weighted sums are accumulated left to right).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference for identical scores).
# Step grids: (low inclusive, high exclusive, score); a value outside every
# step scores like the last step.
PM25_STEPS = [(0, 5, 100), (5, 15, 80), (15, 25, 60), (25, 50, 40), (50, 75, 20), (75, 999, 0)]
NO2_STEPS = [(0, 10, 100), (10, 25, 80), (25, 50, 60), (50, 100, 40), (100, 200, 20), (200, 999, 0)]
AQI_STEPS = [(0, 50, 100), (50, 100, 75), (100, 150, 50), (150, 200, 30), (200, 300, 15), (300, 999, 0)]
POLLUTION_WEIGHTS = {"pm25": 0.5, "no2": 0.3, "aqi": 0.2}
# Weather: comfort band 18..22 °C inclusive, 5 points per degree outside it.
COMFORT_LOW_C, COMFORT_HIGH_C, POINTS_PER_DEGREE = 18.0, 22.0, 5.0
# Upper bounds (exclusive) and scores; precipitation <= 0 scores 100 first.
PRECIP_STEPS = [(0.5, 90.0), (2.0, 70.0), (5.0, 50.0), (10.0, 25.0)]
WIND_STEPS = [(5.0, 100.0), (8.0, 80.0), (12.0, 60.0), (17.0, 30.0)]
UV_STEPS = [(3.0, 100.0), (6.0, 70.0), (8.0, 40.0), (11.0, 20.0)]
WEATHER_WEIGHTS = {"temperature": 0.35, "precipitation": 0.30, "wind": 0.20, "uv": 0.15}
TRAFFIC_STEPS = [(30.0, 100.0), (60.0, 90.0), (120.0, 70.0), (300.0, 40.0), (600.0, 15.0)]
TRAFFIC_MIN_SAMPLES = 5
NEUTRAL_SCORE = 50.0
DEFAULT_WEIGHTS = {"pollution": 0.60, "weather": 0.30, "traffic": 0.10}
GRADE_CUTS = [(80.0, "A"), (65.0, "B"), (50.0, "C"), (35.0, "D")]  # else "E"
# ---------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def step_score(value, steps) -> Column:
    """Score of the first step with ``low <= v < high``, else the last score.

    NULL in gives NULL out (the caller decides how a missing input counts).
    """
    v = _c(value).cast("double")
    expr = None
    for low, high, score in steps:
        cond = (v >= F.lit(float(low))) & (v < F.lit(float(high)))
        expr = F.when(cond, F.lit(float(score))) if expr is None else expr.when(cond, F.lit(float(score)))
    return F.when(v.isNull(), F.lit(None).cast("double")).otherwise(expr.otherwise(F.lit(float(steps[-1][2]))))


def _upper_steps(v: Column, steps, last: float) -> Column:
    expr = None
    for high, score in steps:
        expr = F.when(v < F.lit(high), F.lit(score)) if expr is None else expr.when(v < F.lit(high), F.lit(score))
    return expr.otherwise(F.lit(last))


def weighted_mean(parts) -> Column:
    """Mean of the present (non-NULL) sub-scores, weights renormalised.

    ``parts`` is a list of (score column, weight).  With no present input the
    neutral score 50 is returned.  The quotient is clamped to 0..100: with
    left-to-right float sums e.g. 85 / 0.8499999999999999 = 100.00000000000001,
    one ulp outside the range every score must satisfy.
    """
    num, den = F.lit(0.0), F.lit(0.0)
    for score, weight in parts:
        present = score.isNotNull()
        num = num + F.when(present, score * F.lit(weight)).otherwise(F.lit(0.0))
        den = den + F.when(present, F.lit(weight)).otherwise(F.lit(0.0))
    return F.when(den > 0, F.least(F.lit(100.0), F.greatest(F.lit(0.0), num / den))).otherwise(F.lit(NEUTRAL_SCORE))


def pollution_score(pm25, no2, aqi) -> Column:
    return weighted_mean([
        (step_score(pm25, PM25_STEPS), POLLUTION_WEIGHTS["pm25"]),
        (step_score(no2, NO2_STEPS), POLLUTION_WEIGHTS["no2"]),
        (step_score(aqi, AQI_STEPS), POLLUTION_WEIGHTS["aqi"]),
    ])


def temperature_score(t) -> Column:
    t = _c(t).cast("double")
    diff = F.when(t < COMFORT_LOW_C, F.lit(COMFORT_LOW_C) - t).otherwise(t - F.lit(COMFORT_HIGH_C))
    raw = F.lit(100.0) - diff * F.lit(POINTS_PER_DEGREE)
    return (F.when(t.isNull(), F.lit(None).cast("double"))
            .when((t >= COMFORT_LOW_C) & (t <= COMFORT_HIGH_C), F.lit(100.0))
            .otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), raw))))


def precipitation_score(p) -> Column:
    p = _c(p).cast("double")
    return (F.when(p.isNull(), F.lit(None).cast("double"))
            .when(p <= 0, F.lit(100.0)).otherwise(_upper_steps(p, PRECIP_STEPS, 0.0)))


def wind_score(w) -> Column:
    w = _c(w).cast("double")
    return F.when(w.isNull(), F.lit(None).cast("double")).otherwise(_upper_steps(w, WIND_STEPS, 0.0))


def uv_score(u) -> Column:
    u = _c(u).cast("double")
    return F.when(u.isNull(), F.lit(None).cast("double")).otherwise(_upper_steps(u, UV_STEPS, 0.0))


def weather_score(temperature_c, precipitation_mm, wind_speed_ms, uv_index) -> Column:
    return weighted_mean([
        (temperature_score(temperature_c), WEATHER_WEIGHTS["temperature"]),
        (precipitation_score(precipitation_mm), WEATHER_WEIGHTS["precipitation"]),
        (wind_score(wind_speed_ms), WEATHER_WEIGHTS["wind"]),
        (uv_score(uv_index), WEATHER_WEIGHTS["uv"]),
    ])


def traffic_score(avg_delay_seconds, sample_count) -> Column:
    """Step score of the mean delay, pulled towards 50 below 5 samples."""
    d, n = _c(avg_delay_seconds).cast("double"), _c(sample_count)
    raw = _upper_steps(d, TRAFFIC_STEPS, 0.0)
    confidence = n.cast("double") / F.lit(float(TRAFFIC_MIN_SAMPLES))
    damped = raw * confidence + F.lit(NEUTRAL_SCORE) * (F.lit(1.0) - confidence)
    return (F.when(d.isNull() | F.coalesce(n == 0, F.lit(True)), F.lit(NEUTRAL_SCORE))
            .when(n < TRAFFIC_MIN_SAMPLES, damped).otherwise(raw))


def aggregate_scores(pollution, weather, traffic, weights: dict | None = None) -> Column:
    """Weighted total clamped to 0..100 (default weights .6 / .3 / .1)."""
    w = weights or DEFAULT_WEIGHTS
    total = (_c(pollution) * F.lit(float(w["pollution"])) + _c(weather) * F.lit(float(w["weather"]))
             + _c(traffic) * F.lit(float(w["traffic"])))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def grade(score) -> Column:
    s = _c(score)
    expr = None
    for cut, g in GRADE_CUTS:
        expr = F.when(s >= cut, F.lit(g)) if expr is None else expr.when(s >= cut, F.lit(g))
    return expr.otherwise(F.lit("E"))

"""SQL text of the score formulas, for the DuckDB oracle queries.

Built from the same fixed constants as ``metroscope.functions.scores``, with
the same left-to-right accumulation order so doubles agree bit for bit.
"""

from __future__ import annotations

from metroscope.functions import scores as S


def haversine(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    sl = f"sin(radians({lat2} - {lat1}) / 2.0)"
    so = f"sin(radians({lon2} - {lon1}) / 2.0)"
    a = f"({sl} * {sl} + cos(radians({lat1})) * cos(radians({lat2})) * ({so} * {so}))"
    return f"(6371.0 * (2.0 * asin(sqrt(least({a}, 1.0)))))"


def step(v: str, steps) -> str:
    arms = " ".join(f"WHEN CAST({v} AS DOUBLE) >= {float(lo)} AND CAST({v} AS DOUBLE) < {float(hi)} THEN {float(sc)}"
                    for lo, hi, sc in steps)
    return f"(CASE WHEN {v} IS NULL THEN NULL {arms} ELSE {float(steps[-1][2])} END)"


def upper_steps(v: str, steps, last: float) -> str:
    arms = " ".join(f"WHEN {v} < {hi} THEN {sc}" for hi, sc in steps)
    return f"(CASE {arms} ELSE {last} END)"


def weighted(parts) -> str:
    num, den = "0.0", "0.0"
    for sc, w in parts:
        num = f"({num} + CASE WHEN {sc} IS NOT NULL THEN {sc} * {w} ELSE 0.0 END)"
        den = f"({den} + CASE WHEN {sc} IS NOT NULL THEN {w} ELSE 0.0 END)"
    return f"(CASE WHEN {den} > 0 THEN least(100.0, greatest(0.0, {num} / {den})) ELSE {S.NEUTRAL_SCORE} END)"


def pollution(pm25: str, no2: str, aqi: str) -> str:
    return weighted([(step(pm25, S.PM25_STEPS), 0.5), (step(no2, S.NO2_STEPS), 0.3), (step(aqi, S.AQI_STEPS), 0.2)])


def weather(t: str, p: str, w: str, u: str) -> str:
    lo, hi, k = S.COMFORT_LOW_C, S.COMFORT_HIGH_C, S.POINTS_PER_DEGREE
    temp = (f"(CASE WHEN {t} IS NULL THEN NULL WHEN {t} >= {lo} AND {t} <= {hi} THEN 100.0 "
            f"ELSE greatest(0.0, least(100.0, 100.0 - (CASE WHEN {t} < {lo} THEN {lo} - {t} ELSE {t} - {hi} END) * {k})) END)")
    prec = f"(CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 0 THEN 100.0 ELSE {upper_steps(p, S.PRECIP_STEPS, 0.0)} END)"
    wind = f"(CASE WHEN {w} IS NULL THEN NULL ELSE {upper_steps(w, S.WIND_STEPS, 0.0)} END)"
    uv = f"(CASE WHEN {u} IS NULL THEN NULL ELSE {upper_steps(u, S.UV_STEPS, 0.0)} END)"
    return weighted([(temp, 0.35), (prec, 0.3), (wind, 0.2), (uv, 0.15)])


def traffic(d: str, n: str) -> str:
    raw = upper_steps(d, S.TRAFFIC_STEPS, 0.0)
    conf = f"(CAST({n} AS DOUBLE) / 5.0)"
    return (f"(CASE WHEN {d} IS NULL OR coalesce({n} = 0, true) THEN 50.0 "
            f"WHEN {n} < 5 THEN {raw} * {conf} + 50.0 * (1.0 - {conf}) ELSE {raw} END)")


def total(p: str, w: str, t: str, weights=None) -> str:
    wt = weights or S.DEFAULT_WEIGHTS
    return (f"greatest(0.0, least(100.0, {p} * {float(wt['pollution'])} + {w} * {float(wt['weather'])}"
            f" + {t} * {float(wt['traffic'])}))")


def grade(s: str) -> str:
    arms = " ".join(f"WHEN {s} >= {cut} THEN '{g}'" for cut, g in S.GRADE_CUTS)
    return f"(CASE {arms} ELSE 'E' END)"

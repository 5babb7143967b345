"""Boundary tables of the scalar score and text functions."""

import math

import pytest
from pyspark.sql import functions as F

from metroscope.functions import formats as fm
from metroscope.functions import mobility as mb
from metroscope.functions import scores as sc
from metroscope.functions.geo import haversine_km


def one(spark, expr, data, schema):
    return [r[0] for r in spark.createDataFrame(data, schema).select(expr).collect()]


def test_grades(spark):
    cases = [(100.0, "A"), (80.0, "A"), (79.99, "B"), (65.0, "B"), (64.9, "C"), (50.0, "C"), (49.0, "D"),
             (35.0, "D"), (34.9, "E"), (0.0, "E")]
    got = one(spark, sc.grade("s"), [(s,) for s, _ in cases], "s double")
    assert got == [g for _, g in cases]


def test_pollution(spark):
    data = [(15.0, 30.0, 60), (10.0, None, None), (None, None, None), (42.0, 21.2, 42), (-1.0, 1000.0, 999)]
    got = one(spark, sc.pollution_score("pm25", "no2", "aqi"), data, "pm25 double, no2 double, aqi int")
    assert got[0] == pytest.approx(63.0)
    assert got[1] == 80.0 and got[2] == 50.0
    assert got[3] == pytest.approx(64.0)
    assert got[4] == 0.0  # outside every step -> last score


def test_weather(spark):
    data = [(20.0, 0.0, 1.0, None), (20.0, 15.0, None, None), (None, None, None, None), (14.5, 0.0, 4.5, 4.5),
            (-30.0, 0.3, 20.0, 12.0)]
    got = one(spark, sc.weather_score("t", "p", "w", "u"), data, "t double, p double, w double, u double")
    assert got[0] == 100.0  # 85 / 0.8499999999999999 clamped to the score range
    assert got[1] == pytest.approx(53.846, abs=1e-3)
    assert got[2] == 50.0
    assert got[3] == pytest.approx(89.375)
    assert got[4] == pytest.approx((0 * .35 + 90 * .3 + 0 * .2 + 0 * .15) / 1.0)


def test_traffic(spark):
    data = [(10.0, 100), (10.0, 2), (None, 0), (700.0, 100), (45.0, 0), (110.0, 3)]
    got = one(spark, sc.traffic_score("d", "n"), data, "d double, n int")
    assert got == [100.0, 70.0, 50.0, 0.0, 50.0, pytest.approx(62.0)]


def test_total_is_clamped(spark):
    got = one(spark, sc.aggregate_scores("p", "w", "t", {"pollution": 1.0, "weather": 1.0, "traffic": 1.0}),
              [(90.0, 90.0, 90.0)], "p double, w double, t double")
    assert got == [100.0]


@pytest.mark.parametrize("aqi,cat,label,color", [
    (None, "unknown", "?", "#9CA3AF"), (0, "good", "Bon", "#10B981"), (50, "good", "Bon", "#10B981"),
    (51, "moderate", "Modéré", "#F59E0B"), (100, "moderate", "Modéré", "#F59E0B"),
    (101, "unhealthy_sensitive", "Mauvais (sensibles)", "#F97316"), (150, "unhealthy_sensitive", "Mauvais (sensibles)", "#F97316"),
    (151, "unhealthy", "Mauvais", "#EF4444"), (200, "unhealthy", "Mauvais", "#EF4444"),
    (201, "very_unhealthy", "Très mauvais", "#A855F7"), (300, "very_unhealthy", "Très mauvais", "#A855F7"),
    (301, "hazardous", "Dangereux", "#7C2D12")])
def test_aqi_bands(spark, aqi, cat, label, color):
    df = spark.createDataFrame([(aqi,)], "a int")
    r = df.select(fm.aqi_category("a"), fm.aqi_label("a"), fm.aqi_color("a")).first()
    assert tuple(r) == (cat, label, color)


def test_delay_texts(spark):
    data = [(75,), (-90,), (0,), (30,), (-15,), (90,), (None,), (61,), (-61,)]
    df = spark.createDataFrame(data, "s int")
    got = [tuple(r) for r in df.select(fm.format_delay_clock("s"), fm.format_delay_minutes("s")).collect()]
    assert got == [("+1m 15s", "+1 min"), ("-1m 30s", "-2 min"), ("0s", "à l'heure"), ("+30s", "à l'heure"),
                   ("-15s", "à l'heure"), ("+1m 30s", "+1 min"), (None, "?"), ("+1m 1s", "+1 min"),
                   ("-1m 1s", "-2 min")]


def test_mode_inference(spark):
    data = [("metro", "STIF:Line::C01371:", None, "metro"), ("rail", "x", None, "rer"), ("TRAM", "x", None, "tram"),
            ("bus", "x", None, "bus"), (None, "STIF:Line::C01742:", None, "rer"), ("ferry", "STIF:Line::C01729:", None, "rer"),
            (None, "STIF:Line::C99999:", "SNCF", "train"), (None, "STIF:Line::C99999:", "RATP", "unknown"),
            (None, None, None, "unknown")]
    df = spark.createDataFrame([d[:3] for d in data], "m string, l string, o string")
    assert [r[0] for r in df.select(mb.infer_mode("m", "l", "o")).collect()] == [d[3] for d in data]


def test_line_helpers(spark):
    df = spark.createDataFrame([("STIF:Line::C01371:", "STIF:Operator::RATP:", " #7b388c ", "C01390")],
                               "l string, o string, c string, r string")
    r = df.select(mb.short_line_code("l"), mb.operator_name("o"), mb.normalize_color("c"), mb.build_line_id("r"),
                  mb.normalize_color(F.lit("abc")), mb.build_line_id(F.lit(""))).first()
    assert tuple(r) == ("C01371", "RATP", "#7B388C", "STIF:Line::C01390:", None, None)


def test_haversine(spark):
    df = spark.createDataFrame([(48.8566, 2.3522, 48.8566, 2.3522), (48.8566, 2.3522, 48.8049, 2.1204),
                                (48.8566, 2.3522, 45.7640, 4.8357)], "a double, b double, c double, d double")
    fwd = [r[0] for r in df.select(haversine_km("a", "b", "c", "d")).collect()]
    back = [r[0] for r in df.select(haversine_km("c", "d", "a", "b")).collect()]
    assert fwd[0] == 0.0 and 16 < fwd[1] < 18 and 380 < fwd[2] < 400
    assert all(math.isclose(x, y, rel_tol=1e-12) for x, y in zip(fwd, back))


def test_fixed_formatting_matches_python(spark):
    import random
    random.seed(7)
    vals = [0.15, 0.25, 2.675, 12.5, 13.5, -2.5, 7.25, 99.95, 1e6 + 0.05] + [random.uniform(-500, 500) for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    for digits in (0, 1, 2):
        got = [r[0] for r in df.select(fm.fmt_fixed("x", digits)).collect()]
        assert got == [f"{v:.{digits}f}" for v in vals]


def test_grade_palettes(spark):
    df = spark.createDataFrame([("A",), ("b",), ("E",), ("Z",)], "g string")
    got = [tuple(r) for r in df.select(fm.grade_color("g"), fm.grade_color("g", "ui"), fm.grade_advice("g")).collect()]
    assert [g[0] for g in got] == ["#1B7E3D", None, "#E40520", None]      # service palette: exact grades
    assert [g[1] for g in got] == ["#10B981", "#84CC16", "#EF4444", "#9CA3AF"]  # UI palette: any case, grey default
    assert got[0][2].startswith("🟢 Excellent trajet")

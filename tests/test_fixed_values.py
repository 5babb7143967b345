"""Fixed values pinned by literals: the oracles are built from the same constants, so they cannot notice a change."""

from metroscope.functions import scores as s
from metroscope.functions import text as t


def test_score_grids():
    cuts = lambda steps: [(low, score) for low, _, score in steps]
    assert cuts(s.PM25_STEPS) == [(0, 100), (5, 80), (15, 60), (25, 40), (50, 20), (75, 0)]
    assert cuts(s.NO2_STEPS) == [(0, 100), (10, 80), (25, 60), (50, 40), (100, 20), (200, 0)]
    assert cuts(s.AQI_STEPS) == [(0, 100), (50, 75), (100, 50), (150, 30), (200, 15), (300, 0)]
    for steps in (s.PM25_STEPS, s.NO2_STEPS, s.AQI_STEPS):  # no holes between steps
        assert [high for _, high, _ in steps[:-1]] == [low for low, _, _ in steps[1:]] and steps[-1][1] == 999
    assert s.PRECIP_STEPS == [(0.5, 90), (2, 70), (5, 50), (10, 25)]
    assert s.WIND_STEPS == [(5, 100), (8, 80), (12, 60), (17, 30)]
    assert s.UV_STEPS == [(3, 100), (6, 70), (8, 40), (11, 20)]
    assert s.TRAFFIC_STEPS == [(30, 100), (60, 90), (120, 70), (300, 40), (600, 15)]


def test_weights_and_grades():
    assert s.POLLUTION_WEIGHTS == {"pm25": 0.5, "no2": 0.3, "aqi": 0.2}
    assert s.WEATHER_WEIGHTS == {"temperature": 0.35, "precipitation": 0.3, "wind": 0.2, "uv": 0.15}
    assert s.DEFAULT_WEIGHTS == {"pollution": 0.6, "weather": 0.3, "traffic": 0.1}
    assert (s.COMFORT_LOW_C, s.COMFORT_HIGH_C, s.POINTS_PER_DEGREE, s.TRAFFIC_MIN_SAMPLES, s.NEUTRAL_SCORE) == (18, 22, 5, 5, 50)
    assert s.GRADE_CUTS == [(80, "A"), (65, "B"), (50, "C"), (35, "D")]


def test_bands_and_routes():
    assert t.AIR_BANDS_10 == [(25, 9, 10), (50, 7, 8), (75, 5, 6), (100, 4, 4), (150, 3, 3), (200, 2, 2)] and t.AIR_TOP_10 == (1, 1)
    assert t.TRAFFIC_BANDS_10 == [(30, 10), (60, 8), (120, 6), (300, 4)] and t.TRAFFIC_TOP_10 == 2
    assert {k: len(v) for k, v in t.INTENT_TOOLS.items()} == {
        "greeting": 0, "help": 1, "air_quality": 1, "weather": 1, "traffic": 1, "journey_score": 2, "journey_compare": 2,
        "general_knowledge": 0}
    assert t.LANGUAGES == ["fr", "en"] and (t.DEFAULT_INTENT, t.DEFAULT_LANGUAGE) == ("general_knowledge", "fr")

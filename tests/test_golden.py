"""End-to-end golden case: one waypoint next to every feed sample."""

import pytest
from pyspark.sql import functions as F

from metroscope.functions import mobility as mb
from metroscope.operators import facts, scoring, sinks
from metroscope.sources import air as s_air
from metroscope.sources import stop_visits as s_visits
from metroscope.sources import weather as s_weather
from tests.samples import AIR_FEED, AIR_QUALITY, FORECAST, STOP_MONITORING, dumps

AS_OF = "2031-09-03 07:00:00"


def _score(spark, journey_ref):
    b = spark.createDataFrame([("f", dumps(STOP_MONITORING))], "source_file string, raw string")
    v = facts.stop_visit_rows(s_visits.scan_stop_visits(b, journey_ref=journey_ref))
    v = v.withColumn("input_pos", F.coalesce(mb.best_time(), F.lit("9999-01-01").cast("timestamp")))
    path = sinks.scratch_path(spark, "golden")
    sinks.insert_if_absent(v, path, ["stop_id", "line_id", "vehicle_journey_key", "recorded_at"], ["input_pos"],
                           {"vehicle_journey_key": mb.vehicle_journey_key()})
    visits = spark.read.parquet(path)
    air = s_air.scan_air(spark.createDataFrame([("a", dumps(AIR_FEED))], "source_file string, raw string"))
    fc = spark.createDataFrame([("quay", 1, "Quay", dumps(FORECAST))], "point_id string, fetch_id int, point_name string, raw string")
    aq = spark.createDataFrame([("quay", 1, dumps(AIR_QUALITY))], "point_id string, fetch_id int, raw string")
    wx = s_weather.scan_weather(fc, aq)
    journeys = spark.createDataFrame([("j1", "Trajet", "c", 1)], "journey_id string, journey_label string, comparison_id string, input_pos int")
    wps = spark.createDataFrame([("j1", 0, 48.951, 2.209)], "journey_id string, pos int, latitude double, longitude double")
    return scoring.score_journeys(journeys, wps, air, wx, visits, AS_OF).first()


# By hand: pollution .5*80 + .3*60 + .2*75 = 73; weather .35*87 + .3*70 + .2*80 + .15*70 = 77.95.
# Traffic: delays 50, -45, 60 (mean 21.7 -> 100, three of five samples -> 80); with dated journey
# references also 200 (mean 66.25 -> 70, four of five -> 66).
def test_golden_reference_journey_ref(spark):
    r = _score(spark, "reference")
    assert r.pollution_score == pytest.approx(73.0)
    assert r.weather_score == pytest.approx(77.95)
    assert r.traffic_score == pytest.approx(80.0)
    assert r.overall_score == pytest.approx(75.185)
    assert r.grade == "B" and r.warnings == []


def test_golden_dated_journey_ref(spark):
    r = _score(spark, "dated")
    assert r.traffic_score == pytest.approx(66.0)
    assert r.overall_score == pytest.approx(73.785)

"""Feed samples through the scans (bronze JSON -> silver rows)."""

import datetime as dt

from pyspark.sql import functions as F

from metroscope.operators import facts
from metroscope.sources import air as s_air
from metroscope.sources import journeys as s_j
from metroscope.sources import lines as s_lines
from metroscope.sources import stop_visits as s_visits
from metroscope.sources import weather as s_weather
from tests.samples import AIR_FEED, AIR_QUALITY, FORECAST, LINE_PAGE, LINE_PAGE_2, STOP_MONITORING, dumps

UTC = dt.timezone.utc


def ts(h, m, s=0):
    return dt.datetime(2031, 9, 3, h, m, s)


def _bronze(spark, docs):
    return spark.createDataFrame([(f"f{i}", d) for i, d in enumerate(docs)], "source_file string, raw string")


def test_stop_visits(spark):
    ok, rej = s_visits.scan_stop_visits(_bronze(spark, [dumps(STOP_MONITORING)]), with_rejects=True)
    silver = facts.stop_visit_rows(ok)
    got = {r.direction: r for r in silver.collect()}
    assert len(got) == 5 and rej.count() == 1
    first = got["Quai Nord"]
    assert (first.line_name, first.transport_mode, first.operator, first.delay_seconds) == ("T77", "tram", "KEOLIS", 50)
    assert first.vehicle_journey_id is None  # the framed reference has no value
    assert first.recorded_at == ts(6, 18, 40)
    bus = got["Mairie"]  # plain members; only departure times
    assert (bus.line_id, bus.line_name, bus.transport_mode, bus.delay_seconds) == ("STIF:Line::C04416:", "310", "bus", -45)
    train = got["Hôpital"]
    assert (train.line_name, train.transport_mode, train.delay_seconds) == ("C07001", "train", 60)
    assert train.expected_arrival == ts(6, 51)  # minute precision with offset
    shuttle = got["Parc"]  # the first element that yields a value
    assert (shuttle.line_name, shuttle.transport_mode) == ("Navette", "unknown")
    assert shuttle.delay_seconds is None and shuttle.recorded_at == ts(6, 20)  # response time fallback


def test_stop_visits_dated_and_degenerate(spark):
    dated = s_visits.scan_stop_visits(_bronze(spark, [dumps(STOP_MONITORING)]), journey_ref="dated")
    assert sorted(r[0] for r in dated.select("vehicle_journey_id").collect() if r[0]) == ["D-501", "D-502"]
    empty = _bronze(spark, ["{}", '{"Siri": {}}', '{"Siri": {"ServiceDelivery": {"StopMonitoringDelivery": []}}}',
                            "not json"])
    assert s_visits.scan_stop_visits(empty).count() == 0


def test_air(spark):
    bad = [dumps({"status": "error", "data": "Unknown station"}),
           dumps({"status": "ok", "data": {"idx": 1, "city": {"name": "x"}, "time": {"iso": "2031-09-03T14:00:00Z"}}}),
           dumps({"status": "ok", "data": {"idx": 2, "city": {"geo": [48.0, 2.0]}, "time": {}}})]
    no_iaqi = dumps({"status": "ok", "data": {"aqi": "-", "idx": 3, "city": {"geo": [48.0, 2.0]},
                                              "time": {"iso": "2031-09-03T14:00:00Z"}}})
    ok, rej = s_air.scan_air(_bronze(spark, [dumps(AIR_FEED), no_iaqi, *bad]), with_rejects=True)
    assert rej.count() == 3
    r = {x.station_id: x for x in ok.collect()}
    a = r["@8117"]
    assert (a.latitude, a.longitude, a.aqi, a.pm25, a.pm10, a.no2, a.o3, a.temperature_c, a.humidity_pct,
            a.pressure_hpa, a.attribution) == (48.95, 2.21, 67, 13.0, 31.0, 27.5, 12.0, 19.0, 71.0, 1009.0, "AtmoTest")
    assert a.measured_at == ts(6, 0)
    b = r["@3"]
    assert b.aqi is None and b.pm25 is None and b.station_name == "@3"


def test_loose_ints(spark):
    docs = [dumps({"status": "ok", "data": {"aqi": v, "idx": i, "city": {"geo": [48.0, 2.0]},
                                            "time": {"iso": "2031-09-03T14:00:00Z"}}})
            for i, v in enumerate([42, "42", "-", "--5", 42.0, "-7", None])]
    got = sorted((r.station_id, r.aqi) for r in s_air.scan_air(_bronze(spark, docs)).collect())
    assert got == [("@0", 42), ("@1", 42), ("@2", None), ("@3", None), ("@4", None), ("@5", -7), ("@6", None)]


def test_weather(spark):
    fc = spark.createDataFrame([("quay", 1, "Quay", dumps(FORECAST)), ("hill", 1, "Hill", dumps(FORECAST)),
                                ("bad", 1, "Bad", dumps({"latitude": 1.0}))],
                               "point_id string, fetch_id int, point_name string, raw string")
    aq = spark.createDataFrame([("quay", 1, dumps(AIR_QUALITY))], "point_id string, fetch_id int, raw string")
    ok, rej = s_weather.scan_weather(fc, aq, with_rejects=True)
    r = {x.point_id: x for x in ok.collect()}
    assert rej.count() == 1 and set(r) == {"quay", "hill"}
    p = r["quay"]
    assert (p.temperature_c, p.apparent_temperature_c, p.wind_speed_ms, p.wind_direction_deg, p.aqi_european, p.pm25,
            p.no2, p.uv_index, p.birch_pollen, p.grass_pollen, p.is_day, p.weather_code) == (
        24.6, 25.9, 6.0, 140.0, 3.0, 9.5, 31.0, 3.4, 0.0, 7.5, True, 61)
    assert p.observed_at == ts(6, 15)  # zone-less time stamped UTC
    assert r["hill"].uv_index is None and r["hill"].temperature_c == 24.6
    local = s_weather.scan_weather(fc.filter("point_id = 'quay'"), aq, tz="local").first()
    assert local.observed_at == ts(5, 15)


def test_lines(spark):
    pages = spark.createDataFrame([(0, dumps(LINE_PAGE)), (100, dumps(LINE_PAGE_2))], "page_offset int, raw string")
    r = {x.line_id: x for x in s_lines.scan_lines(pages).collect()}
    assert set(r) == {f"STIF:Line::{c}:" for c in ("C02205", "C04416", "C07001", "C08888")}
    t = r["STIF:Line::C02205:"]  # the first of two records stays
    assert (t.short_name, t.color_web_hex, t.text_color_hex, t.network_name) == ("T77", "#0A64C8", "#FAFAFA", None)
    bus = r["STIF:Line::C04416:"]
    assert bus.color_web_hex == "#EE1133" and bus.text_color_hex is None


def test_journey_specs(spark):
    specs = spark.createDataFrame([("quay:Le quai:48.7,2.1:48.9,2.6",), ("short:x:48.8,2.3",), ("bad:x:1,2:a,b",)],
                                  "spec string")
    j, w, rej = s_j.parse_journey_specs(specs)
    assert [r.journey_id for r in j.collect()] == ["quay"]
    assert sorted((r.pos, r.latitude, r.longitude) for r in w.collect()) == [(0, 48.7, 2.1), (1, 48.9, 2.6)]
    assert sorted(r.reason for r in rej.collect()) == ["needs id:label and two waypoints", "point is not lat,lon"]

"""Inputs beyond former bounds: long journey specs, long replies, deep JSON, oversized numbers; archive round trip."""

import json
import random

from pyspark.sql import functions as F

from metroscope.functions import jsonvals as jv
from metroscope.functions import mobility as mb
from metroscope.functions import text as tx
from metroscope.operators import facts, topn
from metroscope.sources import bronze, journeys, stop_visits
from metroscope.sources import weather as s_weather
from metroscope.operators import sinks
from tests.samples import FORECAST, STOP_MONITORING, dumps


def test_every_waypoint_of_a_long_spec(spark):
    spec = "long:Long:" + ":".join(f"48.{i:05d},2.0" for i in range(3000))
    _, w, rejects = journeys.parse_journey_specs(spark.createDataFrame([(spec,), ("a:b",)], "spec string"))
    assert w.count() == 3000 and [r.reason for r in rejects.collect()] == ["needs id:label and two waypoints"]


def test_replies_of_any_length_and_white_space(spark):
    body = '{"intent": "weather", "language": "en", "note": "' + "x" * 5000 + '"}'
    replies = [body, "\n\t ```json\n" + body + "``` \n", "  " + body]
    i, lang = tx.normalize_intent("r")
    got = spark.createDataFrame([(r,) for r in replies], "r string").select(i.alias("i"), lang.alias("l")).collect()
    assert [tuple(r) for r in got] == [("weather", "en")] * 3


def test_json_values_of_any_shape(spark):
    cases = [("x", "x"), ("  x\n", "x"), ("", None), (5, None), (True, None), ("5", "5"), ("true", "true"), ("{x", "{x"), ("[x", "[x"),
             ({"value": "x"}, "x"), ({"value": " "}, None), ({"value": 7}, None), ({"value": "7"}, "7"), ({"lang": "fr", "value": "x"}, "x"),
             ({"other": "x"}, None), ([], None), (["", None, {"value": ""}, "y"], "y"), ([{"value": ["x"]}], "x"), ([[["x"]]], "x"),
             ({"value": {"value": {"value": "x"}}}, "x"), ([[[[[{"value": [{"value": "a\"b"}]}]]]]], 'a"b'), (None, None)]
    df = spark.createDataFrame([(i, json.dumps({"m": c})) for i, (c, _) in enumerate(cases)], "i int, raw string")
    df = df.select("i", F.try_variant_get(F.try_parse_json("raw"), "$.m", "variant").alias("v")).select("i", jv.json_value("v").alias("t"))
    assert [r.t for r in sorted(df.collect(), key=lambda r: r.i)] == [want for _, want in cases]


def _python_value(x):
    if isinstance(x, str):
        return x.strip() or None
    if isinstance(x, dict):
        return _python_value(x.get("value"))
    if isinstance(x, list):
        return next((t for t in map(_python_value, x) if t), None)
    return None


def _values(spark, cases):
    df = spark.createDataFrame([(i, json.dumps({"m": c})) for i, c in enumerate(cases)], "i int, raw string")
    df = df.select("i", F.try_variant_get(F.try_parse_json("raw"), "$.m", "variant").alias("v")).select("i", jv.json_value("v").alias("t"))
    return [r.t for r in sorted(df.collect(), key=lambda r: r.i)]


def test_json_values_at_any_depth_equal_a_recursion(spark):
    rnd = random.Random(4)

    def shape(depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.25:
            return rnd.choice(["", " ", "x", " y ", "7", "true", "a[b", 'q"]}{', None, 5, True, 1.5])
        if kind < 0.65:
            return [shape(depth - 1) for _ in range(rnd.randint(0, 4))]
        return {rnd.choice(["value", "value", "other"]): shape(depth - 1), **({"lang": shape(depth - 1)} if kind > 0.85 else {})}
    cases = [[[[], ["x"]]], [{"value": [[""], ["x"]]}], {"value": [[], {"value": ["x"]}]}, [[["", [[" ", {"value": [[{"value": ["deep"]}]]}]]], "late"]]]
    cases += [shape(d) for d in (1, 2, 3, 4, 5, 6, 7) for _ in range(40)]
    tower = "t"
    for i in range(60):
        tower = ["", [], tower] if i % 2 else {"value": tower, "other": ["no"]}
    got = _values(spark, [*cases, tower])
    assert got == [_python_value(c) for c in cases] + ["t"]


def test_a_deeply_nested_mandatory_member_keeps_its_visit(spark):
    doc = json.loads(dumps(STOP_MONITORING))
    visits = doc["Siri"]["ServiceDelivery"]["StopMonitoringDelivery"][0]["MonitoredStopVisit"]
    want = stop_visits.scan_stop_visits(spark.createDataFrame([("f", dumps(doc))], "source_file string, raw string")).count()
    visits[0]["MonitoringRef"] = [[], [[""], [{"value": [[], ["STIF:StopPoint:Q:1:"]]}]]]
    got = stop_visits.scan_stop_visits(spark.createDataFrame([("f", dumps(doc))], "source_file string, raw string"))
    assert got.count() == want and got.filter("stop_id = 'STIF:StopPoint:Q:1:'").count() == 1


def test_oversized_values_are_null_not_failures(spark):
    df = spark.createDataFrame([(json.dumps({"a": "9" * 25, "b": 3_000_000_000, "c": " 12 "}),)], "raw string")
    v = lambda k: F.try_variant_get(F.try_parse_json("raw"), f"$.{k}", "variant")
    r = df.select(v("a").alias("a"), v("b").alias("b"), v("c").alias("c")).select(
        jv.safe_int("a").alias("a"), jv.json_loose_int("b").alias("b"), jv.safe_int("c").alias("c")).first()
    assert (r.a, r.b, r.c) == (None, None, 12)
    far = spark.sql("SELECT timestamp'0001-01-01' AS aimed_arrival, timestamp'9999-01-01' AS expected_arrival, "
                    "CAST(NULL AS timestamp) AS aimed_departure, CAST(NULL AS timestamp) AS expected_departure")
    assert far.select(mb.delay_seconds()).first()[0] is None
    odd = {**FORECAST, "current": {**FORECAST["current"], "weather_code": 70000}}
    fc = spark.createDataFrame([("p", 1, "P", dumps(odd))], "point_id string, fetch_id int, point_name string, raw string")
    assert s_weather.scan_weather(fc).first().weather_code is None


def test_top_n_without_a_limit_ranks_everything(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("k"), "id")
    got = topn.top_n_per_key(df, ["k"], [F.col("id").desc()], 0).collect()
    assert len(got) == 500 and {r.rank for r in got if r.k == 0} == set(range(1, 251))


def test_indented_files_and_the_archive_read_back(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"prim_{i}.json").write_text(dumps(STOP_MONITORING, indent=2), encoding="utf-8")
    whole = bronze.read_bronze(spark, str(tmp_path))
    assert whole.count() == 2
    direct = stop_visits.scan_stop_visits(whole)
    assert direct.count() == 10
    path = sinks.scratch_path(spark, "t-archive")
    bronze.write_bronze(whole.select("raw", F.lit("prim").alias("source"), F.lit("2031-09-03").alias("ingest_date")), path)
    back = facts.stop_visit_rows(stop_visits.scan_stop_visits(bronze.read_archive(spark, path), keep=("ingest_date",)))
    cols = ["stop_id", "line_id", "direction", "delay_seconds", "recorded_at"]
    assert sorted(map(str, back.select(*cols).collect())) == sorted(map(str, facts.stop_visit_rows(direct).select(*cols).collect()))
    name = spark.range(1).select(bronze.archive_name(F.lit("STIF:StopPoint:Q:90417:"), F.lit("2031-09-03 06:20:00").cast("timestamp"))).first()[0]
    assert name == "prim_STIF_StopPoint_Q_90417_20310903_062000.json"

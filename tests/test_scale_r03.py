"""Steps that must not grow faster than their input: what they read, where rows move, and that results stay the same."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from metroscope.functions import jsonvals as jv
from metroscope.operators import spatial
from metroscope.sources import stop_visits
from test_beyond_bounds import _python_value
from test_spatial import _brute


# ------------------------------------------------------------------ stop visits
def _response(stops):
    visits = [{"MonitoringRef": s, "MonitoredVehicleJourney": {"LineRef": {"value": "STIF:Line::C1:"}}} for s in stops]
    return json.dumps({"Siri": {"ServiceDelivery": {"ResponseTimestamp": "2031-01-01T00:00:00Z", "StopMonitoringDelivery": [
        {"MonitoredStopVisit": []}, {"MonitoredStopVisit": visits}]}}}, ensure_ascii=False)


def test_members_read_as_text_equal_the_recursion(spark):
    rnd = random.Random(6)

    def shape(depth):
        kind = rnd.random()
        if depth == 0 or kind < 0.3:
            return rnd.choice(["", " ", "x", " y ", "7", "true", "[b", "{c", '{"value":"no"}', "[]", "'q", "é\\", 'q"]}{', None, 5, True, 1.5])
        if kind < 0.6:
            return [shape(depth - 1) for _ in range(rnd.randint(0, 3))]
        return {rnd.choice(["value", "value", "other"]): shape(depth - 1), **({"lang": shape(depth - 1)} if kind > 0.85 else {})}
    cases = [shape(d) for d in (0, 1, 2, 3) for _ in range(60)]
    # every shape alone in its document, and all in one
    docs = [(str(i), _response([c])) for i, c in enumerate(cases)] + [("all", _response(cases))]
    rows = stop_visits.scan_stop_visits(spark.createDataFrame(docs, "source_file string, raw string")).collect()
    want = {i: _python_value(c) for i, c in enumerate(cases)}
    assert {int(r.source_file): r.stop_id for r in rows if r.source_file != "all"} == {i: t for i, t in want.items() if t}
    assert {r.visit_pos: r.stop_id for r in rows if r.source_file == "all"} == {i: t for i, t in want.items() if t}
    assert {r.delivery_pos for r in rows} == {1}


def test_usual_shapes_are_settled_by_their_text(spark):
    usual = ["x", {"value": "x"}, [{"value": "x"}], ["x", "y"], {"value": "7"}, {"value": None}, [], {"ref": {"value": "1"}, "other": "y"}]
    texts = [json.dumps(x) for x in usual]
    texts[0] = "x"  # a string member is read as its content
    got = spark.createDataFrame([(texts,)], "t array<string>").select(jv.plain_values(F.col("t")).alias("r")).first().r
    assert [x.text for x in got] == ["x", "x", "x", "x", "7", None, None, None] and not any(x.odd for x in got)
    hidden = spark.createDataFrame([(["5", "true", '{"value":["x"]}', '[[],"x"]', '["a\\"b"]'],)], "t array<string>")
    assert all(x.odd for x in hidden.select(jv.plain_values(F.col("t")).alias("r")).first().r)
    plain = spark.createDataFrame([('{"a":["b"]}', True), ('{"a":"[b"}', False), ("{'a':'[b'}", False), ('{"a":"\\u005bb"}', False), ('{"a":"l\'arrêt"}', True)], "raw string, want boolean")
    assert all(r.got == r.want for r in plain.select("want", jv.texts_are_plain("raw").alias("got")).collect())


# ------------------------------------------------------------------ nearest sensor
def _near(spark, strategy):
    rnd = random.Random(12)
    pts = [(i, 48 + rnd.uniform(0, 2), 1.5 + rnd.uniform(0, 2)) for i in range(400)] + [(900, 10.0, -60.0), (901, 48.5, 2.0), (902, None, 2.0)]
    sens = [(f"s{j:04d}", 48 + rnd.uniform(0, 2), 1.5 + rnd.uniform(0, 2)) for j in range(80)] + [("dup-b", 48.5, 2.0), ("dup-a", 48.5, 2.0)]
    P = spark.createDataFrame(pts, "pid int, latitude double, longitude double")
    S = spark.createDataFrame(sens, "sensor_id string, latitude double, longitude double")
    return spatial.nearest(P, S, ["pid"], prefix="n_", strategy=strategy), _brute([p for p in pts if p[1] is not None], sens) | {902: None}


def test_grid_points_never_move(spark):
    near, want = _near(spark, "grid")
    assert {r.pid: r.n_id for r in near.collect()} == want
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert "pid" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)  # only sensors are grouped


def test_a_forced_scan_leaves_few_sensors_to_the_formula(spark):
    near, want = _near(spark, "scan")
    assert {r.pid: r.n_id for r in near.filter("latitude IS NOT NULL").collect()} == {k: v for k, v in want.items() if v}
    assert "ArrowEvalPython" in near._jdf.queryExecution().executedPlan().toString()
    xyz = spatial._unit(np.array([48.5, 48.6, 48.6]), np.array([2.0, 2.1, 2.1]))
    points = spatial._unit(np.array([48.5, 48.6, np.nan]), np.array([2.01, 2.1, 2.0]))
    assert [x.tolist() for x in spatial.closest_in_blocks(xyz, points)] == [[0], [1, 2], [0]]


# ------------------------------------------------------------------ boards and loads
def test_boards_and_loads_scan_their_feed_once(spark, monkeypatch):
    from metroscope.operators import bucketed, sinks
    from metroscope.plans.queries import REGISTRY
    d, seen = "/root/testdata/sf0.001", []
    parses = lambda df: "from_json" in df._jdf.queryExecution().optimizedPlan().toString()
    assert not parses(REGISTRY["stop_board"][0](spark, d))  # the sort reads stored rows
    for cls, name, at in ((sinks, "insert_if_absent", 0), (bucketed.BucketedTarget, "insert", 1)):
        def spy(*args, _plain=getattr(cls, name), _at=at, **kw):
            seen.append(parses(args[_at]))
            return _plain(*args, **kw)
        monkeypatch.setattr(cls, name, spy)
    REGISTRY["load_visits"][0](spark, d)
    REGISTRY["load_visits_bucketed"][0](spark, d)
    assert seen == [False] * 4

"""Nearest-sensor and radius joins against brute force."""

import math
import random

import numpy as np
import pytest

from metroscope.operators import spatial


def hav(a, b, c, d):
    r1, r2 = math.radians(a), math.radians(c)
    dl, do = math.radians(c - a), math.radians(d - b)
    x = math.sin(dl / 2) ** 2 + math.cos(r1) * math.cos(r2) * math.sin(do / 2) ** 2
    return 6371.0 * 2 * math.asin(math.sqrt(min(x, 1.0)))


def _data(seed, n_pts, n_sens, spread=2.0, world=False):
    rnd = random.Random(seed)
    if world:
        pts = [(i, rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for i in range(n_pts)]
        sens = [(f"s{j:04d}", rnd.uniform(-89, 89), rnd.uniform(-180, 180)) for j in range(n_sens)]
    else:
        pts = [(i, 48 + rnd.uniform(0, spread), 1.5 + rnd.uniform(0, spread)) for i in range(n_pts)]
        sens = [(f"s{j:04d}", 48 + rnd.uniform(0, spread / 2), 1.5 + rnd.uniform(0, spread / 2)) for j in range(n_sens)]
        sens += [("dup-a", 48.5, 2.0), ("dup-b", 48.5, 2.0)]  # exact tie -> smallest id
        pts += [(n_pts, 48.5, 2.0), (n_pts + 1, 10.0, -60.0)]  # on the tie, and far from everything
    return pts, sens


def _brute(pts, sens):
    out = {}
    for pid, a, b in pts:
        out[pid] = min((hav(a, b, c, d), sid) for sid, c, d in sens)[1] if sens else None
    return out


@pytest.mark.parametrize("strategy", ["scan", "cells", "grid"])
@pytest.mark.parametrize("world", [False, True])
def test_nearest_matches_brute_force(spark, strategy, world):
    pts, sens = _data(3, 300, 60, world=world)
    P = spark.createDataFrame(pts, "pid int, latitude double, longitude double")
    S = spark.createDataFrame(sens, "sensor_id string, latitude double, longitude double")
    got = {r.pid: r.n_id for r in spatial.nearest(P, S, ["pid"], prefix="n_", strategy=strategy).collect()}
    assert got == _brute(pts, sens)


def test_nearest_without_sensors_keeps_points(spark):
    P = spark.createDataFrame([(1, 48.0, 2.0)], "pid int, latitude double, longitude double")
    S = spark.createDataFrame([], "sensor_id string, latitude double, longitude double")
    for strategy in ("scan", "cells", "grid"):
        r = spatial.nearest(P, S, ["pid"], prefix="n_", strategy=strategy).collect()
        assert [(x.pid, x.n_id, x.n_distance_km) for x in r] == [(1, None, None)]


@pytest.mark.parametrize("radius", [0.5, 5.0, 60.0])
def test_within_radius_matches_brute_force(spark, radius):
    rnd = random.Random(11)
    pts = [(i, rnd.uniform(-85, 85), rnd.uniform(-180, 180)) for i in range(150)]
    pts += [(999, 84.9, 179.99), (998, 48.85, 2.35)]
    sens = [(f"s{j}", a + rnd.uniform(-0.3, 0.3), b + rnd.uniform(-0.3, 0.3)) for j, (_, a, b) in enumerate(pts)]
    sens += [("pole", 84.95, -179.99), ("paris", 48.86, 2.36)]
    sens = [(s, max(-89.9, min(89.9, a)), (b + 180) % 360 - 180) for s, a, b in sens]
    P = spark.createDataFrame(pts, "pid int, latitude double, longitude double")
    S = spark.createDataFrame(sens, "sensor_id string, latitude double, longitude double")
    got = sorted((r.pid, r.s_id) for r in spatial.within_radius(P, S, radius).collect())
    want = sorted((pid, sid) for pid, a, b in pts for sid, c, d in sens if hav(a, b, c, d) <= radius)
    assert got == want


@pytest.mark.parametrize("strategy", ["cells", "grid"])
def test_nearest_with_hot_location_and_dense_cluster(spark, strategy):
    # a third of the sensors share one location, another third sit in a 100 m cluster
    rnd = random.Random(5)
    sens = [(f"c{j:04d}", 48.8, 2.3) for j in range(200)]
    sens += [(f"d{j:04d}", 48.9 + rnd.uniform(0, 0.001), 2.4 + rnd.uniform(0, 0.001)) for j in range(200)]
    sens += [(f"u{j:04d}", 48 + rnd.uniform(0, 2), 1.5 + rnd.uniform(0, 2)) for j in range(200)]
    pts = [(i, 48 + rnd.uniform(0, 2), 1.5 + rnd.uniform(0, 2)) for i in range(300)]
    pts += [(1000 + i, 48.9 + rnd.uniform(-0.01, 0.01), 2.4 + rnd.uniform(-0.01, 0.01)) for i in range(50)]
    pts += [(2000, 48.8, 2.3)]
    P = spark.createDataFrame(pts, "pid int, latitude double, longitude double")
    S = spark.createDataFrame(sens, "sensor_id string, latitude double, longitude double")
    got = {r.pid: r.n_id for r in spatial.nearest(P, S, ["pid"], prefix="n_", strategy=strategy).collect()}
    assert got == _brute(pts, sens)


def test_empty_region_beside_a_dense_cluster_keeps_short_lists():
    rng = np.random.default_rng(2)
    lat = np.concatenate([48.9 + rng.uniform(0, 1e-3, 3000), rng.uniform(-80, 80, 300)])
    lon = np.concatenate([2.4 + rng.uniform(0, 1e-3, 3000), rng.uniform(-180, 180, 300)])
    xyz = spatial._unit(lat, lon)
    cells = [c for root in range(72) for c in spatial.leaves(xyz, *divmod(root, 12))]
    sizes = np.array([len(c[3]) for c in cells])
    assert sizes.max() <= spatial.LEAF_CANDIDATES and sizes.sum() < 40 * len(lat)
    area = sum(spatial.SPLIT ** (-2.0 * c[0]) for c in cells)
    assert area == 72  # the leaves cover every root cell exactly
    lookup = {c[:3]: c[3] for c in cells}
    for _ in range(4000):
        a, b = 48.9 + rng.normal(0, 1) * 10.0 ** rng.uniform(-4, 1.5), 2.4 + rng.normal(0, 1) * 10.0 ** rng.uniform(-4, 1.5)
        a = min(max(a, -89.9), 89.9)
        hits = [lookup[k] for lv in range(13) if (k := (lv, int((a + 90) // (30 / 4**lv)), int((b + 180) // (30 / 4**lv)) % (12 * 4**lv))) in lookup]
        assert len(hits) == 1
        d = ((xyz - spatial._unit(np.array(a), np.array(b))) ** 2).sum(1)
        assert int(d.argmin()) in hits[0] or d[hits[0]].min() <= d.min() + 1e-15


def test_one_broadcast_of_a_checked_index(spark):
    pts, sens = _data(8, 200, 90)
    P = spark.createDataFrame(pts, "pid int, latitude double, longitude double")
    S = spark.createDataFrame(sens, "sensor_id string, latitude double, longitude double")
    plan = spatial.nearest(P, S, ["pid"], prefix="n_")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "Aggregate" not in plan and "Exchange hash" not in plan


def test_an_index_too_large_to_broadcast_gives_way_to_shuffles(spark, monkeypatch):
    pts, sens = _data(9, 120, 70)
    P = spark.createDataFrame(pts, "pid int, latitude double, longitude double")
    S = spark.createDataFrame(sens, "sensor_id string, latitude double, longitude double")
    monkeypatch.setattr(spatial, "INDEX_MAX_BYTES", 10)
    assert {r.pid: r.n_id for r in spatial.nearest(P, S, ["pid"], prefix="n_").collect()} == _brute(pts, sens)


def test_odd_coordinates(spark):
    _, sens = _data(10, 1, 80, world=True)
    S = spark.createDataFrame([*sens, ("bad1", None, 2.0), ("bad2", float("nan"), 2.0), ("a-pole", 90.0, 17.0)], "sensor_id string, latitude double, longitude double")
    pts = [(1, 90.0, 0.0), (2, -90.0, 50.0), (3, 12.0, 180.0), (4, 12.0, -180.0), (5, 12.0, 540.0), (6, 89.9, 200.0), (7, 95.0, 10.0)]
    P = spark.createDataFrame([*pts, (8, None, 1.0), (9, 1.0, None)], "pid int, latitude double, longitude double")
    got = {r.pid: r.n_id for r in spatial.nearest(P, S, ["pid"], prefix="n_", payload=["sensor_id"]).collect()}
    want = _brute(pts, [*sens, ("a-pole", 90.0, 17.0)])
    assert got == want | {8: None, 9: None}

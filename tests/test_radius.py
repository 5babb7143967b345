"""Radius search: rows are shared by all tasks, border pairs are decided by the distance formula, on both join paths."""

import math
import random

import pytest
from pyspark.sql import functions as F

from metroscope.functions.geo import haversine_km
from metroscope.operators import spatial
from metroscope.plans.queries import r6, r6_pairs

PLACE = "latitude double, longitude double"


def _pairs(spark, pts, sens, radius):
    P = spark.createDataFrame(pts, "pid int, " + PLACE)
    S = spark.createDataFrame(sens, "sensor_id string, " + PLACE + ", kind string")
    return sorted((r.pid, r.s_id, r.s_distance_km, r.s_kind) for r in spatial.within_radius(P, S, radius, payload=["kind"]).collect())


def _brute(spark, pts, sens, radius):
    P = spark.createDataFrame(pts, "pid int, la double, lo double")
    S = spark.createDataFrame(sens, "sid string, sla double, slo double, kind string")
    d = haversine_km("la", "lo", "sla", "slo")
    return sorted(tuple(r) for r in P.crossJoin(S).select("pid", "sid", d.alias("d"), "kind").filter(F.col("d") <= radius).collect())


def _world(seed=4):
    rnd = random.Random(seed)
    pts = [(i, rnd.uniform(48, 48.4), rnd.uniform(2, 2.4)) for i in range(60)]
    pts += [(100 + i, rnd.choice([-1, 1]) * rnd.uniform(88, 90), rnd.uniform(-180, 180)) for i in range(40)]
    pts += [(200 + i, rnd.uniform(-1, 1), rnd.choice([-180.0, 180.0, 179.99, -179.99])) for i in range(40)]
    sens = [(f"s{i}", max(-90.0, min(90.0, a + rnd.uniform(-0.05, 0.05))), b + rnd.uniform(-0.05, 0.05), "k") for i, a, b in pts]
    return pts, sens + [("same", *pts[0][1:], "x"), ("pole", 90.0, 0.0, "x"), ("far", 48.2, 362.2, "x")]


@pytest.mark.parametrize("few", [10**6, 10])
@pytest.mark.parametrize("radius", [0.0, 0.001, 5.0, 150.0, 12_000.0])
def test_pairs_and_distances_equal_the_cross_join(spark, monkeypatch, few, radius):
    monkeypatch.setattr(spatial, "RADIUS_BROADCAST_MAX_SENSORS", few)
    pts, sens = _world()
    assert _pairs(spark, pts, sens, radius) == _brute(spark, pts, sens, radius)


def test_a_pair_at_the_radius_is_decided_by_its_distance(spark):
    pts, sens = _world(9)
    every = _brute(spark, pts, sens, 5.0)
    for _, _, d, _ in random.Random(1).sample([p for p in every if p[2] > 0], 4):
        assert d in {p[2] for p in _pairs(spark, pts, sens, d)}
        assert d not in {p[2] for p in _pairs(spark, pts, sens, math.nextafter(d, 0))}


def test_places_without_finite_coordinates_have_no_pairs(spark):
    odd = [None, float("nan"), float("inf"), float("-inf")]
    pts = [(i, v, 2.0) for i, v in enumerate(odd)] + [(10 + i, 48.0, v) for i, v in enumerate(odd)] + [(99, 48.0, 2.0), (98, 1e300, 2.0)]
    sens = [(f"s{i}", a, b, None) for i, a, b in pts]
    assert [p[:2] for p in _pairs(spark, pts, sens, 5.0)] == [(98, "s98"), (99, "s99")]


def test_points_of_one_dense_place_are_shared_by_all_tasks(spark):
    P = spark.range(4000).select(F.col("id").alias("pid"), F.lit(48.0).alias("latitude"), F.lit(2.0).alias("longitude")).coalesce(1)
    S = spark.createDataFrame([(f"s{i}", 48.0, 2.0 + i / 1e5) for i in range(50)], "sensor_id string, " + PLACE)
    tasks = spatial.within_radius(P, S, 5.0).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 200_000 and len(tasks) >= 4 and max(r["count"] for r in tasks) <= 50_000


def test_points_in_many_partitions_keep_as_many_tasks(spark):
    P = spark.range(0, 4000, 1, 90).select(F.col("id").alias("pid"), F.lit(48.0).alias("latitude"), F.lit(2.0).alias("longitude"))
    S = spark.createDataFrame([("s", 48.0, 2.0)], "sensor_id string, " + PLACE)
    assert spatial.within_radius(P, S, 5.0).groupBy(F.spark_partition_id()).count().count() == 90


def test_points_of_a_region_follow_each_other(spark):
    town = F.pmod(F.hash("id"), F.lit(30))
    P = spark.range(0, 6000, 1, 3).select(F.col("id").alias("pid"), town.alias("town"), (40.0 + town / 2.0 + F.col("id") % 89 / 1e5).alias("latitude"),
                                          (2.0 + F.col("id") % 97 / 1e5).alias("longitude"))
    S = spark.createDataFrame([(f"s{i}", 40.0 + i / 2.0, 2.0) for i in range(30)], "sensor_id string, " + PLACE)
    rows = spatial.within_radius(P, S, 5.0).select(F.spark_partition_id().alias("task"), "town").collect()
    assert len(rows) == 6000
    for task in {r["task"] for r in rows}:
        met = [r["town"] for r in rows if r["task"] == task]
        assert sum(a != b for a, b in zip(met, met[1:])) == len(set(met)) - 1


def test_rounding_of_pairs_is_the_rounding_of_all_queries(spark):
    rnd = random.Random(2)
    values = [rnd.uniform(-10, 10) for _ in range(3000)] + [k / 10**7 for k in range(-300, 300)] + [rnd.uniform(-1, 1) * 10.0**k for k in range(-12, 20)]
    values += [5e-7 - 1e-9, -1e-9, 0.0, -0.0, 1.0000005, 2.5e-6, None, float("nan"), float("inf"), float("-inf")]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select(r6("v").alias("a"), r6_pairs("v").alias("b")).collect()
    assert [repr(r.a) for r in rows] == [repr(r.b) for r in rows]

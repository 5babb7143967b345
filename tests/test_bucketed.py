"""Bucketed load target: same rows as the plain load, target read in place."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from metroscope.operators import sinks
from metroscope.operators.bucketed import BucketedTarget
from metroscope.operators.snapshots import first_per_key

SCHEMA = "k string, ts timestamp, v int, pos int"
KEYS = ["k", "ts"]


def _batch(spark, seed, n=400):
    r = random.Random(seed)
    rows = [("hot" if r.random() < 0.3 else f"k{r.randrange(20)}", dt.datetime(2024, 1, 1 + r.randrange(4), r.randrange(24)), i, i)
            for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def _target(spark, path):
    return BucketedTarget(spark, path, spark.createDataFrame([], "k string, ts timestamp, v int").schema, KEYS, "ts", 4)


def test_equals_plain_load_over_batches_and_sessions(spark):
    plain, path = sinks.scratch_path(spark, "t-plain"), sinks.scratch_path(spark, "t-bucketed")
    for seed in (1, 2, 2, 3):
        want = sinks.insert_if_absent(_batch(spark, seed), plain, KEYS, ["pos"])
        target = _target(spark, path)
        assert target.insert(_batch(spark, seed), ["pos"]) == want
        spark.sql(f"DROP TABLE {target.table}")  # the next batch opens the files anew; the table is external
    got = sorted(tuple(r) for r in _target(spark, path).rows().collect())
    assert got == sorted(tuple(r) for r in spark.read.parquet(plain).collect())
    assert _target(spark, path).insert(_batch(spark, 1, 0), ["pos"]) == {"total": 0, "inserted": 0}


def test_target_is_not_shuffled_and_pruned_by_date(spark):
    target = _target(spark, sinks.scratch_path(spark, "t-plan"))
    target.insert(_batch(spark, 5), ["pos"])
    span = (dt.datetime(2024, 1, 2, 1), dt.datetime(2024, 1, 2, 9))
    absent = target.absent(first_per_key(_batch(spark, 6), KEYS, ["pos"]), span)
    plan = absent._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line)
    above = plan.splitlines()[:plan.splitlines().index(scan)]
    depth = len(scan) - len(scan.lstrip(" :+-"))
    # the operators between the join and the scan are those with smaller indentation right above it
    chain = []
    for line in reversed(above):
        d = len(line) - len(line.lstrip(" :+-"))
        if d < depth:
            chain.append(line)
            depth = d
        if "SortMergeJoin" in line and d <= depth:
            break
    assert "SortMergeJoin" in chain[-1] and not any("Exchange" in c for c in chain), plan
    assert "Bucketed: true" in scan and "PartitionFilters: [isnotnull(load_date" in scan, plan
    kept = {(r.k, r.ts) for r in target.rows().collect()}
    rows = _batch(spark, 6).filter(F.col("ts").between(*span))
    out = target.absent(first_per_key(rows, KEYS, ["pos"]), span).collect()
    assert {(r.k, r.ts) for r in out} == {(r.k, r.ts) for r in rows.collect()} - kept


def test_rows_without_event_time_are_refused(spark):
    target = _target(spark, sinks.scratch_path(spark, "t-null"))
    with pytest.raises(ValueError):
        target.insert(spark.createDataFrame([("a", None, 1, 1)], SCHEMA), ["pos"])
    assert target.insert(spark.createDataFrame([(None, dt.datetime(2024, 1, 1), 1, 1)], SCHEMA), ["pos"])["inserted"] == 1

"""Plan-shape guards: no pair-emitting joins; filters and projections reach the scan."""

import pytest

import __spark_entry__ as E
from metroscope.operators import snapshots
from metroscope.plans import adapters as A
from metroscope.plans.queries import REGISTRY

SIDE_EFFECTS = ("load_", "stream_", "upsert_", "cleanup_", "bronze_")
PAIR_JOINS = ("CartesianProduct", "BroadcastNestedLoopJoin")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in REGISTRY if not n.startswith(SIDE_EFFECTS)])
def test_no_pair_emitting_join(spark, name):
    plan = _plan(E.queries()[name](spark, "/root/testdata/sf0.001"))
    assert not any(j in plan for j in PAIR_JOINS), name


def test_window_bound_and_columns_reach_the_scan(spark):
    df = E.queries()["latest_air_6h"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts," in plan  # as_of - 6 h pushed into parquet
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in plan


def test_latest_times_are_hashed_and_rows_stay_where_they_are(spark):
    air = A.air_raw(spark, "/root/testdata/sf0.001")
    times = _plan(snapshots.peaks(snapshots.trailing(air, "measured_at", A.AS_OF, hours=24), ["station_id"], "measured_at"))
    assert times.count("HashAggregate") >= 2 and "Sort" not in times
    plan = _plan(snapshots.latest_air(air, A.AS_OF, hours=24))
    below = plan[plan.rindex("Exchange hashpartitioning"):]  # rows meet the broadcast times before anything moves them
    assert "BroadcastHashJoin" in below and "LeftSemi" in below and "Window" not in plan


@pytest.mark.parametrize("max_keys", [10, 10**6])
def test_latest_rows_with_ties_and_nulls(spark, max_keys):
    rows = [("a", 1, "x", 1.0), ("a", 3, "x", 1.0), ("a", 3, "y", 0.5), ("a", 3, "x", 9.0), (None, 2, "n", 0.0), (None, 5, "m", 0.0), ("b", None, "q", 1.0), ("b", None, "r", 2.0)]
    rows += [(f"k{i}", i % 3, str(i), float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, ts int, t string, v double").repartition(5)
    want = {}
    for k, ts, t, v in rows:
        want[k] = max(want.get(k, (-1, "", -1.0)), (-1 if ts is None else ts, t, v))
    got = {r.k: (-1 if r.ts is None else r.ts, r.t, r.v) for r in snapshots.latest_per_key(df, ["k"], "ts", tie_cols=["t"], max_keys=max_keys).collect()}
    assert got == want

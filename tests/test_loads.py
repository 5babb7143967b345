"""Sinks: insert-if-absent idempotence, upsert, clean-up, retention."""

import datetime as dt

from pyspark.sql import functions as F

from metroscope.functions import mobility as mb
from metroscope.operators import facts, sinks
from metroscope.sources import stop_visits as s_visits
from tests.samples import STOP_MONITORING, dumps

KEY = ["stop_id", "line_id", "vehicle_journey_key", "recorded_at"]


def _visits(spark, journey_ref="reference"):
    b = spark.createDataFrame([("f", dumps(STOP_MONITORING))], "source_file string, raw string")
    v = facts.stop_visit_rows(s_visits.scan_stop_visits(b, journey_ref=journey_ref))
    # input order = stop board order (best time, NULL last)
    return v.withColumn("input_pos", F.coalesce(mb.best_time(), F.lit("9999-01-01").cast("timestamp")))


def test_insert_if_absent_first_wins_and_idempotent(spark):
    path = sinks.scratch_path(spark, "t-load")
    v = _visits(spark)
    first = sinks.insert_if_absent(v, path, KEY, ["input_pos"], {"vehicle_journey_key": mb.vehicle_journey_key()})
    assert first == {"total": 5, "inserted": 4}  # the two tram visits share the load key
    kept = spark.read.parquet(path).filter(F.col("line_id") == "STIF:Line::C02205:").collect()
    assert [r.delay_seconds for r in kept] == [50]  # the earlier one on the board wins
    again = sinks.insert_if_absent(v, path, KEY, ["input_pos"], {"vehicle_journey_key": mb.vehicle_journey_key()},
                                   range_col="recorded_at")
    assert again == {"total": 5, "inserted": 0}
    assert spark.read.parquet(path).count() == 4


def test_insert_dated_keeps_all_and_empty_batch(spark):
    path = sinks.scratch_path(spark, "t-load2")
    v = _visits(spark, "dated")
    assert sinks.insert_if_absent(v, path, KEY, ["input_pos"],
                                  {"vehicle_journey_key": mb.vehicle_journey_key()}) == {"total": 5, "inserted": 5}
    empty = sinks.scratch_path(spark, "t-empty")
    assert sinks.insert_if_absent(v.limit(0), empty, KEY, ["input_pos"],
                                  {"vehicle_journey_key": mb.vehicle_journey_key()}) == {"total": 0, "inserted": 0}


def test_upsert_dimension(spark):
    cur = spark.createDataFrame([("L1", "a", "x"), ("L2", "b", "y")], "line_id string, short_name string, color string")
    v1 = sinks.upsert_dimension(cur.selectExpr("*", "1 AS pos"), None, sinks.scratch_path(spark, "t-dim"), "line_id", ["pos"],
                                as_of="2024-01-01 00:00:00")
    new = spark.createDataFrame([("L2", None, "z", 1), ("L3", "c", "w", 2), ("L3", "c2", "w2", 3)],
                                "line_id string, short_name string, color string, pos int")
    v2 = sinks.upsert_dimension(new, v1, sinks.scratch_path(spark, "t-dim"), "line_id", ["pos"], as_of="2024-02-01 00:00:00")
    r = {x.line_id: x for x in v2.collect()}
    assert (r["L1"].short_name, r["L1"].last_refreshed_at) == ("a", dt.datetime(2024, 1, 1))
    assert (r["L2"].short_name, r["L2"].color) == (None, "z")  # NULL overwrites too
    assert r["L3"].short_name == "c2"  # last row of the batch wins
    assert r["L2"].last_refreshed_at == dt.datetime(2024, 2, 1)


def test_cleanup_and_retention(spark):
    df = spark.createDataFrame([("a", 48.5, 2.0), ("b", 51.0, 2.0), ("c", None, 2.0), ("d", 50.0, 3.5)],
                               "station_id string, latitude double, longitude double")
    out = sinks.scratch_path(spark, "t-clean")
    assert sinks.delete_outside_box(df, out) == {"before": 4, "removed": 2, "after": 2}
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == ["a", "d"]
    ev = spark.createDataFrame([("L", dt.datetime(2024, 1, 1, 10, 5), 10), ("L", dt.datetime(2024, 1, 1, 10, 50), 30),
                                ("L", dt.datetime(2024, 5, 1, 10, 0), 99)], "line_id string, ts timestamp, d int")
    r = sinks.retention_rollup(ev, "ts", ["line_id"], ["d"], "2024-05-02 00:00:00", days=90).collect()
    assert [(x.hour, x.n_rows, x.avg_d, x.min_d, x.max_d) for x in r] == [(dt.datetime(2024, 1, 1, 10), 2, 20.0, 10, 30)]


def test_insert_with_range_bound_still_finds_repeats(spark):
    path = sinks.scratch_path(spark, "t-range")
    schema = "k string, ts timestamp, v int, pos int"
    a = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 10), 1, 1), ("b", dt.datetime(2024, 1, 1, 12), 2, 2)], schema)
    assert sinks.insert_if_absent(a, path, ["k", "ts"], ["pos"], range_col="ts") == {"total": 2, "inserted": 2}
    # a later batch repeating one earlier key (inside its own time range) plus new rows
    b = spark.createDataFrame([("a", dt.datetime(2024, 1, 1, 10), 9, 1), ("c", dt.datetime(2024, 1, 1, 11), 3, 2),
                               ("c", dt.datetime(2024, 1, 1, 11), 4, 3)], schema)
    assert sinks.insert_if_absent(b, path, ["k", "ts"], ["pos"], range_col="ts") == {"total": 3, "inserted": 1}
    got = sorted((r.k, r.v) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1), ("b", 2), ("c", 3)]

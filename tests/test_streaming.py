"""Streams over several micro-batches equal the batch operators."""

import datetime as dt

from pyspark.sql import functions as F

from metroscope.functions import mobility as mb
from metroscope.operators import facts
from metroscope.sources import stop_visits as s_visits
from metroscope.streaming import landing as L
from tests.samples import STOP_MONITORING, dumps


def _doc(minute_shift):
    import copy
    d = copy.deepcopy(STOP_MONITORING)
    sd = d["Siri"]["ServiceDelivery"]
    for deliv in sd["StopMonitoringDelivery"]:
        for v in deliv["MonitoredStopVisit"]:
            if "RecordedAtTime" in v:
                v["RecordedAtTime"] = f"2031-09-03T{6 + minute_shift // 60:02d}:{minute_shift % 60:02d}:00Z"
    return dumps(d)


def test_stream_dedupe_and_hourly_equal_batch(spark):
    p = L.scratch(spark, "t-stream")
    docs = [_doc(0), _doc(0), _doc(30), _doc(90)]  # a repeated response and two later ones
    for i, d in enumerate(docs):  # four landings -> four micro-batches
        L.land(spark.createDataFrame([(d,)], "raw string"), p["landing"])
    stream = facts.stop_visit_rows(s_visits.scan_stop_visits(L.stream_scan(spark, p["landing"], max_files_per_trigger=1)))
    rows = stream.withColumn("input_pos", F.col("recorded_at"))
    L.stream_insert_if_absent(rows, p["out"], ["stop_id", "line_id", "vehicle_journey_key", "recorded_at"],
                              ["input_pos"], p["ckpt"], {"vehicle_journey_key": mb.vehicle_journey_key()})
    batch = s_visits.scan_stop_visits(spark.createDataFrame([(f"f{i}", d) for i, d in enumerate(docs)],
                                                            "source_file string, raw string"))
    want = batch.select("stop_id", "line_id", F.coalesce("vehicle_journey_id", F.lit("")), "recorded_at").distinct().count()
    # 3 keys at 06:00, one visit at the response time of every document, 3 at 06:30, 3 at 07:30
    assert spark.read.parquet(p["out"]).count() == want == 10

    p2 = L.scratch(spark, "t-stream-h")
    stream2 = facts.stop_visit_rows(s_visits.scan_stop_visits(L.stream_scan(spark, p["landing"], max_files_per_trigger=1)))
    L.write_partials(stream2, lambda b: L.hourly_partials(b, "recorded_at"), p2["out"], p2["ckpt"])
    got = sorted((r.hour, r["count"]) for r in L.merge_hourly(spark.read.parquet(p2["out"])).collect())
    assert got == [(dt.datetime(2031, 9, 3, 6, 0), 16), (dt.datetime(2031, 9, 3, 7, 0), 4)]
    L.compact(spark, p2["out"], p2["dim"], L.merge_hourly)
    assert sorted((r.hour, r["count"]) for r in spark.read.parquet(p2["dim"]).drop("batch_id").collect()) == got


HOURS = [[9, 10], [10, 11, 12], [13], [1, 2, 9], [14, 3]]  # late rows in the last two files


def _events(spark, name):
    p = L.scratch(spark, name)
    for i, hours in enumerate(HOURS):
        rows = [(f"k{h}", dt.datetime(2031, 9, 3, h), h * 10, f"f{i}", j) for j, h in enumerate(hours)]
        (spark.createDataFrame(rows, "k string, recorded_at timestamp, delay_seconds int, source_file string, pos int")
         .coalesce(1).write.mode("append").parquet(p["landing"]))
    schema = spark.read.parquet(p["landing"]).schema
    return p, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(p["landing"])


def test_late_rows_are_set_aside_and_counted_once_merged(spark):
    p, stream = _events(spark, "t-late")
    L.stream_insert_bounded(stream, p["out"], p["late"], "recorded_at", "2 HOURS", ["k", "recorded_at"],
                            ["source_file", "pos"], p["ckpt"])
    late = spark.read.parquet(p["late"])
    assert sorted(r.k for r in late.collect()) == ["k1", "k2", "k3", "k9"]
    L.merge_late(spark, p["late"], p["out"], ["k", "recorded_at"], ["source_file", "pos"], range_col="recorded_at")
    assert sorted(r.k for r in spark.read.parquet(p["out"]).collect()) == sorted({f"k{h}" for hs in HOURS for h in hs})


def test_windows_count_late_rows_and_a_replayed_batch_changes_nothing(spark):
    p, stream = _events(spark, "t-roll")
    L.write_partials(stream, L.rolling_partials, p["out"], p["ckpt"])
    key = lambda df: sorted((r.window_start, r.window_end, r.avg_delay_seconds, r.samples) for r in df.collect())
    want = key(L.merge_rolling(L.rolling_partials(spark.read.parquet(p["landing"]))))
    assert key(L.merge_rolling(spark.read.parquet(p["out"]))) == want
    assert len(spark.read.parquet(p["out"]).select("batch_id").distinct().collect()) == len(HOURS)
    first = spark.read.parquet(p["out"]).filter("batch_id = 0").drop("batch_id").collect()
    again = spark.createDataFrame(first, spark.read.parquet(p["out"]).drop("batch_id").schema)
    L.write_batch(again, p["out"], 0)  # the batch runs again after a failure
    assert key(L.merge_rolling(spark.read.parquet(p["out"]))) == want

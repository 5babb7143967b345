"""Streams with state: which row survives, late rows, and how much state is kept."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from metroscope.streaming import landing as L
from metroscope.streaming import stateful as S

T0 = datetime(2031, 3, 1, 12)
SCHEMA = "k string, ts timestamp, pos int, body string"


def _stream(spark, name, batches):
    """One landed file per batch, read one file per micro-batch in order."""
    p = L.scratch(spark, name)
    import os
    import time
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
        df.write.parquet(os.path.join(p["landing"], f"part={i}"))
        time.sleep(1.1)  # files are taken by modification time
    schema = spark.read.parquet(p["landing"]).schema
    return p, spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(p["landing"])


def test_first_rows_survive_whole_and_state_stays_small(spark):
    at = lambda h: T0 + timedelta(hours=h)
    batches = [
        [("a", at(0), 2, "a-second"), ("a", at(0), 1, "a-first"), ("b", at(0), 1, "b"), (None, at(0), 1, "none")],
        [("a", at(0), 0, "a-later-batch"), ("c", at(1), 1, "c"), ("a", at(1), 1, "a-other-time")],
        *[[(f"n{i}-{j}", at(10 * i + 10), 1, "n") for j in range(30)] for i in range(4)],
        [("b", at(0), 1, "b-repeat-and-late"), ("z", at(2), 1, "z-late-and-new"), ("z", at(2), 0, "z-late-first"), ("n3-0", at(40), 1, "repeat")],
    ]
    p, stream = _stream(spark, "t-first", batches)
    progress = S.first_rows(stream, "ts", timedelta(hours=2), ["k", "ts"], ["pos"], p["out"], p["ckpt"])
    got = spark.read.parquet(p["out"])
    want = {("a", at(0), "a-first"), ("b", at(0), "b"), (None, at(0), "none"), ("c", at(1), "c"), ("a", at(1), "a-other-time")}
    want |= {(f"n{i}-{j}", at(10 * i + 10), "n") for i in range(4) for j in range(30)}
    rows = [(r.k, r.ts, r.body) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    assert max(x["state_rows"] for x in progress) <= 70  # of 125 keys: old ones leave with the watermark
    assert sum(x["late_rows"] for x in progress) == 3
    landed = spark.read.parquet(p["landing"])
    assert S.set_aside_late(landed, got, ["k", "ts"], ["pos"], p["late"]) == 1
    late = spark.read.parquet(p["late"]).collect()
    assert [(r.k, r.body) for r in late] == [("z", "z-late-first")]
    # a repeated call replaces the folder
    assert S.set_aside_late(landed, got, ["k", "ts"], ["pos"], p["late"]) == 1


def test_live_rows_change_and_expire(spark):
    at = lambda h: T0 + timedelta(hours=h)
    batches = [[("a", at(0), 1, "a0"), ("a", at(1), 1, "a1"), ("b", at(1), 2, "b1"), ("b", at(1), 3, None)],
               [("a", at(0), 9, "older"), ("a", at(1), 0, "smaller tie"), ("b", at(2), 1, "b2")],
               [("c", at(20), 1, "c20")], [("c", at(21), 1, "c21"), ("d", at(21), 1, "d")]]
    p, stream = _stream(spark, "t-live", batches)
    progress = S.live_rows(stream.drop("part"), ["k"], "ts", timedelta(hours=6), p["out"], p["ckpt"])
    rows = [(r.batch_id, r.k, r.pos, r.body) for r in spark.read.parquet(p["out"]).collect()]
    assert sorted(map(str, rows)) == sorted(map(str, [(0, "a", 1, "a1"), (0, "b", 3, None), (1, "b", 1, "b2"), (2, "c", 1, "c20")] + [(r[0], *r[1:]) for r in rows if r[0] > 2]))
    assert {r[1:] for r in rows if r[0] > 2} == {("c", 1, "c21"), ("d", 1, "d")}
    assert progress[-1]["state_rows"] <= 2  # a and b have expired
    live = L.live_latest(spark.read.parquet(p["out"]).drop("batch_id").filter(F.col("ts") >= F.lit(at(15))), ["k"], "ts", ["k", "ts", "pos", "body"])
    assert {(r.k, r.body) for r in live.collect()} == {("c", "c21"), ("d", "d")}

"""Mergeable roll-ups: batches, late rows, replays and compaction equal one pass over all rows."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from metroscope.operators import rollups, sinks

T0 = datetime(2031, 5, 1)


def _rows(n, seed):
    rnd = random.Random(seed)
    return [(rnd.choice(["l1", "l2", "l3", None, f"x{rnd.randint(0, 60)}"]), T0 + timedelta(minutes=rnd.randint(0, 600)), rnd.choice([None, *range(-50, 400, 7)])) for _ in range(n)]


def _full(spark, rows):
    df = spark.createDataFrame(rows, "line_id string, ts timestamp, delay long")
    hours = df.groupBy("line_id", F.date_trunc("hour", "ts").alias("hour")).agg(
        F.count("*").alias("n_rows"), F.avg("delay").alias("avg_delay"), F.min("delay").alias("min_delay"), F.max("delay").alias("max_delay"))
    lines = df.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count_distinct("line_id").alias("n"))
    return hours, lines, df


def _same(a, b):
    key = lambda rows: sorted(map(str, (tuple(r) for r in rows)))
    assert key(a.collect()) == key(b.collect())


def test_incremental_equals_full_after_late_rows_and_replays(spark):
    batches = [_rows(200, 1), _rows(150, 2), _rows(80, 3)]  # all over the same hours: later batches are late rows
    r = rollups.HourlyRollup(spark, sinks.scratch_path(spark, "rollup"), "ts", ["line_id"], ["delay"], distinct="line_id")
    for i, b in enumerate(batches):
        r.add(spark.createDataFrame(b, "line_id string, ts timestamp, delay long"), i)
    r.add(spark.createDataFrame(batches[1], "line_id string, ts timestamp, delay long"), 1)  # replayed
    hours, lines, df = _full(spark, sum(batches, []))
    for own in (r, r.compact(sinks.scratch_path(spark, "rollup"))):
        _same(own.hours(), hours)
        _same(own.distinct_count(), lines.filter("n > 0"))
        since = T0 + timedelta(hours=4)
        t, window = own.totals(since).first(), df.filter(F.col("ts") >= F.lit(since))
        assert (t.n_rows, t.n_distinct) == (window.count(), window.agg(F.count_distinct("line_id")).first()[0])
        assert t.n_delay == window.filter("delay IS NOT NULL").count() and t.avg_delay == window.agg(F.avg("delay")).first()[0]
    numbers = [x.number for x in spark.read.parquet(f"{r.path}/numbers").collect()]
    assert sorted(numbers) == list(range(1, len(numbers) + 1))


def test_bitmaps_cross_buckets_and_empty_batches(spark):
    r = rollups.HourlyRollup(spark, sinks.scratch_path(spark, "rollup"), "ts", [], ["delay"], distinct="line_id")
    many = spark.range(70_000).select(F.concat(F.lit("v"), "id").alias("line_id"), F.lit(T0).alias("ts"), F.lit(1).cast("long").alias("delay"))
    r.add(many.filter("line_id < 'v5'"), 0)
    r.add(many.limit(0), 1)
    r.add(many, 2)
    t = r.totals().first()
    assert t.n_distinct == 70_000 and t.n_rows > 70_000
    assert r.totals(T0 + timedelta(hours=1)).first().n_rows == 0

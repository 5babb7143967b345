"""Streams and archives at size: groups of keys instead of single keys, and work that does not grow faster than the input."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from metroscope.streaming import stateful as S
from test_stateful import _stream

T0 = datetime(2031, 3, 1, 12)


def test_keys_of_a_time_slot_share_their_state(spark):
    at = lambda s, us=0: T0 + timedelta(seconds=s, microseconds=us)
    # many keys of near times; times a microsecond apart and a missing part are keys of their own
    first = [(f"k{i % 300}", at(i % 300), 5 - i // 300, f"b0-{i}") for i in range(900)]
    second = [("k0", at(0, 1), 1, "other time"), ("k1", at(1), 0, "repeat"), (None, at(1), 2, "none-second"), (None, at(1), 1, "none")]
    p, stream = _stream(spark, "t-slots", [first, second])
    spark.conf.set("spark.sql.shuffle.partitions", 200)
    try:
        progress = S.first_rows(stream, "ts", timedelta(hours=2), ["k", "ts"], ["pos"], p["out"], p["ckpt"])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    got = sorted((r.k or "", r.ts, r.body) for r in spark.read.parquet(p["out"]).collect())
    assert got == sorted([(f"k{i}", at(i), f"b0-{600 + i}") for i in range(300)] + [("k0", at(0, 1), "other time"), ("", at(1), "none")])
    assert max(x["state_rows"] for x in progress) <= 2 * 32  # of 302 keys
    offsets = spark.read.text(f"{p['ckpt']}/offsets").filter(F.col("value").contains("shuffle.partitions"))
    assert offsets.select(F.regexp_extract("value", r'shuffle\.partitions":"(\d+)"', 1).cast("int").alias("n")).agg(F.max("n")).first()[0] <= 12


def test_live_keys_share_their_state_and_keep_whole_numbers(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    first = [(f"k{i % 600}", at(i // 600), i if i % 7 else None, f"b0-{i}") for i in range(1800)]
    second = [("k0", at(0), 9, "older"), ("k1", at(2), 1201, "a smaller tie"), ("k3", at(2), 1203, "b0-1203"), ("k2", at(3), None, "newer"), (None, at(0), 3, "no key")]
    p, stream = _stream(spark, "t-live-parts", [first, second])
    progress = S.live_rows(stream.drop("part"), ["k"], "ts", timedelta(hours=6), p["out"], p["ckpt"], parts=16)
    rows = spark.read.parquet(p["out"]).collect()
    assert {(r.k, r.ts, r.pos, r.body) for r in rows if r.batch_id == 0} == {(f"k{i - 1200}", at(2), i if i % 7 else None, f"b0-{i}") for i in range(1200, 1800)}
    assert {(r.k, r.pos, r.body) for r in rows if r.batch_id == 1} == {("k2", None, "newer"), (None, 3, "no key")}
    assert max(x["state_rows"] for x in progress) <= 16  # of 601 keys


def test_documents_land_in_files_for_every_core_and_three_batches(spark):
    from metroscope.plans import q_streaming as Q
    docs = spark.range(400).select(F.col("id").alias("event_id"), F.concat(F.lit("a\r\n\nb\n"), F.col("id").cast("string")).alias("raw"))
    p, stream = Q._landed(spark, "t-landed", docs)
    landed = spark.read.text(p["landing"])
    assert sorted(r.value for r in landed.collect()) == sorted(f"a b {i}" for i in range(400))
    assert len(landed.inputFiles()) >= 2 * spark.sparkContext.defaultParallelism
    from metroscope.streaming import landing as L
    L.append_batches(stream.select("raw"), p["out"], p["ckpt"])
    stored = spark.read.parquet(p["out"])
    assert stored.select("batch_id").distinct().count() == 3 and stored.count() == 400


def test_archive_is_written_without_a_join_or_a_sort(spark, monkeypatch, tmp_path):
    from pyspark.sql.readwriter import DataFrameWriter
    from metroscope.plans.queries import REGISTRY
    from metroscope.sources import bronze
    seen, plain, text = [], bronze.write_bronze, DataFrameWriter.text

    def spy(df, path, *args, **kw):
        seen.append("Join" in df._jdf.queryExecution().optimizedPlan().toString())
        return plain(df, path, *args, **kw)

    def spy_text(self, *args, **kw):
        seen.append(spark.conf.get(bronze.WRITERS))
        return text(self, *args, **kw)
    monkeypatch.setattr(bronze, "write_bronze", spy)
    monkeypatch.setattr(DataFrameWriter, "text", spy_text)
    assert REGISTRY["bronze_write"][0](spark, "/root/testdata/sf0.001").agg(F.sum("n_files")).first()[0] == spark.read.parquet(
        "/root/testdata/sf0.001/events.parquet").count()
    assert seen == [False, str(bronze.OPEN_FILES)]
    # more partitions than open files: nothing is lost, and the setting is put back
    monkeypatch.setattr(bronze, "OPEN_FILES", 2)
    before = spark.conf.get(bronze.WRITERS, None)
    docs = spark.range(70).select(F.format_string("a\n%d", "id").alias("raw"), F.lit("s").alias("source"), F.format_string("2031-01-%02d", F.col("id") % 7 + 1).alias("ingest_date"))
    plain(docs, str(tmp_path / "archive"))
    got = bronze.read_archive(spark, str(tmp_path / "archive")).collect()
    assert sorted((r.raw, r.ingest_date) for r in got) == sorted((f"a {i}", f"2031-01-{i % 7 + 1:02d}") for i in range(70))
    assert spark.conf.get(bronze.WRITERS, None) == before

"""Streaming forms of the batch operators.

Responses land as JSON lines (one document per line) in a folder; a stream
reads new files with a fixed text schema (no inference), runs the same scan
functions as the batch path, and writes through ``foreachBatch``.

Every sink is safe against replay: a micro-batch writes its own
``batch_id=N`` folder and overwrites it when it runs again, or goes through
the idempotent batch insert.  Aggregates keep no state and no watermark: each
micro-batch stores partial sums that readers merge, so a row counts however
late it comes; ``compact`` folds many batches into one.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metroscope.operators import sinks
from metroscope.operators.snapshots import latest_per_key
from metroscope.sources.bronze import one_line


def land(df: DataFrame, landing_dir: str, raw: str = "raw") -> None:
    """Append raw documents (one JSON per row) as JSON-lines text files."""
    df.select(one_line(F.col(raw)).alias("value")).write.mode("append").text(landing_dir)


def stream_scan(spark: SparkSession, landing_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """R1: streaming ``(source_file, raw)`` rows from the landing folder."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(landing_dir).select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw"))


def run_available(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str,
                  output_mode: str = "append") -> None:
    """Process everything available now through ``fn(batch_df, batch_id)``."""
    q = (df.writeStream.outputMode(output_mode).foreachBatch(fn)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


# ------------------------------------------------------------------ R2 dedupe
def stream_insert_if_absent(df: DataFrame, target: str, key_cols: Sequence[str], order_cols: Sequence[str],
                            checkpoint: str, key_exprs: dict | None = None, range_col: str | None = None) -> None:
    """Exact streaming dedupe: each micro-batch goes through the batch
    insert-if-absent sink, so the table equals a batch load of all input,
    whatever the batch boundaries or lateness."""
    def fn(batch: DataFrame, _bid: int) -> None:
        sinks.insert_if_absent(batch, target, key_cols, order_cols, key_exprs, range_col=range_col)
    run_available(df, fn, checkpoint)


def stream_insert_bounded(df: DataFrame, target: str, late: str, ts: str, delay: str, key_cols: Sequence[str],
                          order_cols: Sequence[str], checkpoint: str, key_exprs: dict | None = None) -> None:
    """Dedupe that looks back a bounded time only.

    Rows within ``delay`` of the latest event time seen so far are inserted if
    absent, comparing with target rows of the batch's own time range.  Older
    rows are set aside in ``late`` (one folder per micro-batch, so they can be
    counted) and join the target with ``merge_late``.
    """
    def fn(batch: DataFrame, bid: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()  # one parse for both outputs
        seen = [batch.agg(F.max(ts).alias("t"))]
        if sinks._exists(spark, target):
            seen.append(spark.read.parquet(target).agg(F.max(ts).alias("t")))
        newest = max((r.t for s in seen for r in s.collect() if r.t is not None), default=None)
        if newest is not None:
            on_time = F.col(ts) >= F.lit(newest) - F.expr(f"INTERVAL {delay}")
            write_batch(batch.filter(~on_time | F.col(ts).isNull()), late, bid)
            sinks.insert_if_absent(batch.filter(on_time), target, key_cols, order_cols, key_exprs, range_col=ts)
        batch.unpersist()
    run_available(df, fn, checkpoint)


def merge_late(spark: SparkSession, late: str, target: str, key_cols: Sequence[str], order_cols: Sequence[str],
               key_exprs: dict | None = None, range_col: str | None = None) -> dict:
    """Insert the rows set aside that are still absent; returns the sink's counts."""
    if not sinks._exists(spark, late):
        return {"total": 0, "inserted": 0}
    rows = spark.read.parquet(late).drop("batch_id")
    return sinks.insert_if_absent(rows, target, key_cols, order_cols, key_exprs, range_col=range_col)


# ------------------------------------------------------------------ replay-safe sinks
def write_batch(batch: DataFrame, out: str, batch_id: int) -> None:
    """Store a micro-batch under its id; running it again replaces it."""
    batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")


def append_batches(df: DataFrame, out: str, checkpoint: str) -> None:
    """R1: every micro-batch under its id."""
    run_available(df, lambda batch, bid: write_batch(batch, out, bid), checkpoint)


def write_partials(df: DataFrame, aggregate: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> None:
    """Store ``aggregate(micro-batch)`` under the batch's id."""
    run_available(df, lambda batch, bid: write_batch(aggregate(batch), out, bid), checkpoint)


def compact(spark: SparkSession, out: str, new_out: str, merge: Callable[[DataFrame], DataFrame]) -> None:
    """Fold all partials of ``out`` into one batch of ``new_out`` (``merge`` must return the partials' columns)."""
    write_batch(merge(spark.read.parquet(out).drop("batch_id")), new_out, 0)


def hourly_partials(df: DataFrame, ts: str) -> DataFrame:
    """R3: rows per hour, as sums that can be merged."""
    return df.groupBy(F.date_trunc("hour", ts).alias("hour")).agg(F.count(F.lit(1)).alias("count"))


def merge_hourly(partials: DataFrame) -> DataFrame:
    return partials.groupBy("hour").agg(F.sum("count").alias("count"))


def rolling_partials(df: DataFrame, ts: str = "recorded_at", length: str = "2 hours", slide: str = "30 minutes") -> DataFrame:
    """R4: per sliding window the sum and number of stored delays."""
    v = df.filter(F.col("delay_seconds").isNotNull())
    g = v.groupBy(F.window(ts, length, slide).alias("w")).agg(F.sum(F.col("delay_seconds").cast("long")).alias("delay_sum"),
                                                               F.count(F.lit(1)).alias("samples"))
    return g.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "delay_sum", "samples")


def merge_rolling(partials: DataFrame) -> DataFrame:
    """Mean stored delay and sample count of every window."""
    g = partials.groupBy("window_start", "window_end").agg(F.sum("delay_sum").alias("s"), F.sum("samples").alias("samples"))
    return g.select("window_start", "window_end", (F.col("s") / F.col("samples")).alias("avg_delay_seconds"), "samples")


def live_latest(df: DataFrame, keys: Sequence[str], ts: str, cols: Sequence[str]) -> DataFrame:
    """R5: latest row per key of a micro-batch, or of all stored partials (the
    same expression merges them); expiry (6 h / 3 h) is the reader's trailing filter."""
    return latest_per_key(df, list(keys), ts, list(cols))


# ------------------------------------------------------------------ R6 enrich
def stream_enrich(df: DataFrame, lines_path: str, out: str, checkpoint: str) -> None:
    """Stream-static join with the line dimension, re-read every micro-batch
    so a refreshed dimension is picked up without restarting."""
    def fn(batch: DataFrame, bid: int) -> None:
        spark = batch.sparkSession
        dim = spark.read.parquet(lines_path).select("line_id", F.col("short_name").alias("dim_short_name"),
                                                    F.col("transport_mode").alias("dim_mode"))
        j = batch.join(dim, "line_id", "left")  # broadcast where the planner measures the dimension small
        write_batch(j.withColumn("display_line_name", F.coalesce("dim_short_name", "line_name", "line_id"))
                     .withColumn("display_mode", F.coalesce("dim_mode", "transport_mode")), out, bid)
    run_available(df, fn, checkpoint)


def scratch(spark: SparkSession, name: str) -> dict[str, str]:
    """Fresh landing / output / checkpoint folders under the shared checkpoint folder."""
    base = sinks.scratch_path(spark, name)
    return {k: os.path.join(base, k) for k in ("landing", "out", "ckpt", "dim", "late")}

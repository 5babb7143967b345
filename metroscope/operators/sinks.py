"""Idempotent loads, dimension upsert, clean-up rewrite and retention rollup.

Sinks write parquet.  Plain parquet has no transactions, so:
* inserts only ever APPEND new files (safe for one writer at a time);
* rewrites (upsert, clean-up) write a NEW path and never overwrite the path
  being read; the caller switches to the returned path.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from metroscope.functions.geo import in_bbox
from metroscope.operators.snapshots import as_of_value, first_per_key
from metroscope.session import ensure_checkpoint_dir


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "sinks", f"{name}-{uuid.uuid4().hex[:12]}")


def insert_if_absent(new: DataFrame, target_path: str, key_cols: Sequence[str], order_cols: Sequence[str],
                     key_exprs: dict | None = None, partition_cols: Sequence[str] = (),
                     range_col: str | None = None) -> dict:
    """Append the rows of ``new`` whose key is not yet in the target.

    Within the batch the first row per key (by ``order_cols``) wins; rows whose
    key already exists are skipped.  ``key_exprs`` adds computed key columns
    (e.g. a NULL-safe journey key) that are not stored.  Returns
    ``{"total": n_in, "inserted": n_written}``; an empty batch writes nothing.

    ``range_col`` names a key column holding the event time: only target rows
    between the batch's min and max of it can collide, so the target is read
    with that range as a predicate (parquet min/max statistics and, for a
    target partitioned by date, partition pruning) instead of whole.
    """
    spark = new.sparkSession
    key_exprs = key_exprs or {}
    kept = [c for c in new.columns if c not in order_cols]
    # parsed once: counts, bounds, dedupe and write all read the stored batch
    path = scratch_path(spark, "batch")
    new.write.parquet(path)
    batch = spark.read.schema(new.schema).parquet(path)
    bounds = [F.min(range_col), F.max(range_col)] if range_col is not None else []
    total, *span = batch.agg(F.count(F.lit(1)), *bounds).first()
    if not total:
        return {"total": 0, "inserted": 0}
    for k, e in key_exprs.items():
        batch = batch.withColumn(k, e)
    firsts = first_per_key(batch, list(key_cols), list(order_cols))
    if _exists(spark, target_path):
        existing = spark.read.parquet(target_path)
        if span:
            existing = existing.filter(F.col(range_col).between(F.lit(span[0]), F.lit(span[1])))
        for k, e in key_exprs.items():
            existing = existing.withColumn(k, e)
        firsts = firsts.join(existing.select(*key_cols), list(key_cols), "left_anti")
    n_out = Observation("inserted")
    w = firsts.select(*kept).observe(n_out, F.count(F.lit(1)).alias("n")).write.mode("append")
    if partition_cols:
        w = w.partitionBy(*partition_cols)
    w.parquet(target_path)
    return {"total": int(total), "inserted": int(n_out.get["n"])}


def upsert_dimension(new: DataFrame, current: DataFrame | None, out_path: str, key: str, order_cols: Sequence[str],
                     as_of=None, stamp_col: str = "last_refreshed_at") -> DataFrame:
    """Insert-or-update by key: every attribute of an incoming row replaces the
    stored one (NULL too), the stamp is set to ``as_of``; rows absent from the
    batch are kept; nothing is deleted.

    Within the batch the LAST row per key by ``order_cols`` (arrival order,
    not stored) wins, as if rows were applied one by one; without an order a
    repeated key would have no defined winner, so it must be given.  Written
    to ``out_path`` (a new version); returns it read back."""
    if not order_cols:
        raise ValueError("order_cols must give the arrival order of the rows")
    spark = new.sparkSession
    payload = [c for c in new.columns if c != key and c not in order_cols]
    last = F.max(F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order_cols)], F.struct(*payload).alias("row")))
    incoming = (new.groupBy(key).agg(last.alias("__l")).select(key, "__l.row.*")
                .withColumn(stamp_col, as_of_value(as_of)))
    merged = incoming
    if current is not None:
        kept = current.join(incoming.select(key), key, "left_anti")
        merged = kept.unionByName(incoming.select(*current.columns), allowMissingColumns=False)
    merged.write.mode("errorifexists").parquet(out_path)
    return spark.read.parquet(out_path)


def delete_outside_box(df: DataFrame, out_path: str, box: dict | None = None) -> dict:
    """Rewrite ``df`` without rows outside the box (NULL coordinates count as
    outside) to ``out_path``; returns counts before / removed / after."""
    inside = in_bbox("latitude", "longitude", box)
    before, removed = Observation("before"), Observation("removed")
    tagged = df.withColumn("__in", inside).observe(before, F.count(F.lit(1)).alias("n"),
                                                   F.count_if(~F.col("__in")).alias("out"))
    tagged.filter("__in").drop("__in").write.mode("errorifexists").parquet(out_path)
    b = before.get
    return {"before": int(b["n"]), "removed": int(b["out"]), "after": int(b["n"]) - int(b["out"])}


def retention_split(df: DataFrame, ts: str, as_of=None, days: int = 90) -> tuple[DataFrame, DataFrame]:
    """(hot, cold): rows newer than ``as_of - days`` and older ones."""
    bound = F.timestamp_micros(F.unix_micros(as_of_value(as_of)) - F.lit(days * 86_400_000_000))
    return df.filter(F.col(ts) >= bound), df.filter(F.col(ts) < bound)


def retention_union(df: DataFrame, ts: str, keys: Sequence[str], measures: Sequence[str], as_of=None,
                    days: int = 90) -> DataFrame:
    """One hourly table over hot and cold data: rolled-up rows for everything
    older than the retention window, and the same aggregates computed from the
    raw rows inside it (``tier`` tells which)."""
    hot, cold = retention_split(df, ts, as_of, days)
    return (_hourly(cold, ts, keys, measures).withColumn("tier", F.lit("cold"))
            .unionByName(_hourly(hot, ts, keys, measures).withColumn("tier", F.lit("hot"))))


def _hourly(df: DataFrame, ts: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for m in measures:
        aggs += [F.avg(m).alias(f"avg_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(*aggs)


def retention_rollup(df: DataFrame, ts: str, keys: Sequence[str], measures: Sequence[str], as_of=None,
                     days: int = 90) -> DataFrame:
    """Cold rows (older than the retention window) rolled up per key and hour:
    row count, and mean / min / max of every measure."""
    _, cold = retention_split(df, ts, as_of, days)
    return _hourly(cold, ts, keys, measures)

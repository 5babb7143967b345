"""Streams that keep bounded state: first row per key, and live latest row per key.

State lies in RocksDB on the executors (checkpointed to the query's folder),
one small entry per key, and leaves it by event-time timers: a key of the
dedupe goes when the watermark passes its event time (a repeat would be late
from then on), a sensor goes when its latest row has expired.  Rows behind the
watermark never reach the state; ``set_aside_late`` finds them again among the
landed rows, stores them beside the target and counts them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from metroscope.operators import sinks
from metroscope.streaming.landing import write_batch

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
TASKS_PER_CORE = 3
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_TIME = 2 ** 62  # stands for a missing event time in a group's state


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, in at most ``TASKS_PER_CORE`` partitions a core: every
    micro-batch starts a Python worker for each, with or without rows.  (A checkpoint keeps the number it began with.)"""
    before = {k: spark.conf.get(k, None) for k in (PROVIDER, PARTITIONS)}
    spark.conf.set(PROVIDER, ROCKS)
    spark.conf.set(PARTITIONS, min(int(spark.conf.get(PARTITIONS)), TASKS_PER_CORE * spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _millis(t) -> int:
    import pandas as pd  # only in a stream's tasks
    return int(pd.Timestamp(t).value // 1_000_000)


def _run(out: DataFrame, target: str, checkpoint: str, output_mode: str) -> list[dict]:
    """Process everything available; every micro-batch under its id (a replay replaces it).  Returns the query's progress."""
    spark = out.sparkSession
    with rocksdb(spark):
        q = (out.writeStream.outputMode(output_mode).foreachBatch(lambda batch, bid: write_batch(batch, target, bid))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
        q.awaitTermination()
    return [{"batch": p.batchId, "rows": p.numInputRows,
            "state_rows": sum(s.numRowsTotal for s in p.stateOperators), "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators)} for p in q.recentProgress]


def _key_text(df: DataFrame, key_cols: Sequence[str]) -> Column:
    """A row's key as one text; two keys have the same text only when Spark groups them together."""
    plain = [F.when(F.col(k) == 0, F.lit(0.0)).otherwise(F.col(k)).alias(k) if isinstance(df.schema[k].dataType, (T.DoubleType, T.FloatType)) else F.col(k)
             for k in key_cols]
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    return F.to_json(F.struct(*plain), exact)


def first_rows(df: DataFrame, ts: str, delay: timedelta, key_cols: Sequence[str], order_cols: Sequence[str], target: str, checkpoint: str,
               parts: int = 32) -> list[dict]:
    """Write the first row of every key of a stream: the earliest micro-batch's, in it the smallest ``order_cols``.

    ``key_cols`` must hold ``ts``, so that repeats of a key share its event time
    and the key's state can go when the watermark (latest event time less
    ``delay``) passes it.  Keys are kept in groups, by time slots one ``delay``
    long and ``parts`` hash parts: a group's rows are compared at once, and its
    state, the keys not yet behind the watermark, goes with its slot.  Rows
    behind the watermark are left to ``set_aside_late``.
    Returns one entry per micro-batch: rows read, state rows (groups), late rows.
    """
    if ts not in key_cols:
        raise ValueError("the key must hold the event time")
    order, names = list(order_cols), list(df.columns)
    slot_ms = max(1, int(delay.total_seconds())) * 1000

    def first(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        behind = state.getCurrentWatermarkMs()
        keys, times = state.get if state.exists else ([], [])
        held = dict(zip(keys, times))
        best = None  # smallest in arrival order of every new key's rows in this micro-batch
        for f in frames:
            f = f[~f["__key"].isin(held.keys())]
            f = f if best is None else pd.concat([best, f])
            best = f.sort_values(order, kind="stable").drop_duplicates("__key") if f["__key"].duplicated().any() else f
        if best is None or best.empty:
            return
        held = {k: t for k, t in held.items() if t >= behind} | dict(zip(best["__key"], best["__ms"].tolist()))
        state.update((list(held.keys()), list(held.values())))
        last = 0 if group[0] is None or group[0] != group[0] else (int(group[0]) + 1) * slot_ms
        state.setTimeoutTimestamp(max(last, behind) + 1)
        yield best[names]

    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    held_in = {"__key": _key_text(df, key_cols), "__ms": F.coalesce(ms, F.lit(NO_TIME)), "__slot": F.floor(ms / slot_ms)}
    grouped = df.withColumns(held_in).withColumn("__part", F.pmod(F.xxhash64("__key"), F.lit(parts)))
    out = (grouped.withWatermark(ts, f"{int(delay.total_seconds())} seconds").groupBy("__slot", "__part")
           .applyInPandasWithState(first, df.schema, "keys array<string>, times array<bigint>", "append", GroupStateTimeout.EventTimeTimeout))
    return _run(out, target, checkpoint, "append")


def set_aside_late(landed: DataFrame, target: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], late: str) -> int:
    """Store the first row of every landed key the stream did not write (it came behind the watermark); their number.

    Both sides are batch reads; ``late`` gets one folder that a repeated call replaces.
    """
    from metroscope.operators.snapshots import first_per_key
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key_cols]
    missing = landed.alias("a").join(target.select(*key_cols).alias("b"), same, "left_anti")
    write_batch(first_per_key(missing, list(key_cols), list(order_cols)), late, 0)
    return landed.sparkSession.read.parquet(f"{late}/batch_id=0").count()


def live_rows(df: DataFrame, keys: Sequence[str], ts: str, expiry: timedelta, target: str, checkpoint: str, parts: int = 256) -> list[dict]:
    """Write a row whenever a key's latest row changes; a key's state goes ``expiry`` behind the newest event time.

    Of rows with equal times the largest by the other columns in order stays.
    The last written row per key is the live one; readers apply the trailing
    filter.  Keys are kept in ``parts`` hash parts whose rows are compared at
    once; a part's state goes when all its keys have expired.  Returns one
    entry per micro-batch.
    """
    schema, names = df.schema, list(df.columns)
    rest = [c for c in names if c != ts and c not in keys]
    after, at = int(expiry.total_seconds() * 1000), [names.index(c) for c in [ts, *rest]]
    held_in = T.StructType([T.StructField("rows", T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("ms", T.LongType()),
                                                                          *[T.StructField(c, schema[c].dataType) for c in [ts, *rest]]])))])

    whole_numbers = {c for c in names if isinstance(schema[c].dataType, T.IntegralType)}

    def plain(row: Sequence, cols: Sequence[str]) -> tuple:
        import pandas as pd  # beside missing values pandas holds whole numbers as floats
        row = [None if x is pd.NaT or (isinstance(x, float) and x != x) else x for x in row]
        return tuple(int(x) if x is not None and c in whole_numbers else x for c, x in zip(cols, row))

    def rank(row: Sequence) -> tuple:
        import pandas as pd
        row = [None if row[0] is None else pd.Timestamp(row[0]), *row[1:]]
        return tuple((x is not None, x if x is not None else 0) for x in row)

    def live(_part, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd
        if state.hasTimedOut:
            state.remove()
            return
        behind = state.getCurrentWatermarkMs()
        held = {r[0]: (r[1], tuple(r[2:])) for r in state.get[0]} if state.exists else {}
        changed = {}
        for f in frames:
            latest = f.groupby("__key")[ts].transform("max")
            f = f[f[ts].eq(latest) | latest.isna()]  # of every key the rows at its latest time
            for key, ms, values in zip(f["__key"], f["__ms"], f[names].itertuples(index=False, name=None)):
                values = plain(values, names)
                row = tuple(values[i] for i in at)
                if key not in held or rank(row) > rank(held[key][1]):
                    held[key], changed[key] = (int(ms), row), values
        if not changed:
            return
        held = {k: x for k, x in held.items() if x[0] + after >= behind}  # the others have expired
        if held:
            state.update(([(k, ms, *row) for k, (ms, row) in held.items()],))
            state.setTimeoutTimestamp(max(max(ms for ms, _ in held.values()) + after, behind + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame.from_records(list(changed.values()), columns=names)

    ms = F.coalesce(F.unix_millis(F.col(ts).cast("timestamp")), F.lit(0))
    grouped = (df.withColumns({"__key": _key_text(df, keys), "__ms": ms})
               .withColumn("__part", F.pmod(F.xxhash64("__key"), F.lit(parts))))
    out = (grouped.withWatermark(ts, f"{after // 1000} seconds").groupBy("__part")
           .applyInPandasWithState(live, schema, held_in, "update", GroupStateTimeout.EventTimeTimeout))
    return _run(out, target, checkpoint, "update")

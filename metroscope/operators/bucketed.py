"""Fact tables bucketed by their load key: inserts that never move the target.

The target of an insert-if-absent is by far the larger side of the anti-join.
Stored as a table partitioned by event date and bucketed by the load key, it
is read bucket by bucket inside the batch's dates: only the batch is
shuffled, into the target's buckets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from metroscope.operators.sinks import _exists, scratch_path
from metroscope.operators.snapshots import first_per_key

DATE_COL = "load_date"


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


class BucketedTarget:
    """A fact table at ``path`` (a shared folder), keyed by ``keys`` (its event time ``ts`` among them).

    ``schema`` are the stored columns, computed key columns included (a bucket
    column must be stored).  ``buckets`` is fixed when the table is created and
    must be given again when it is opened; it is part of the folder name.  Like
    every sink it takes one writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: Sequence[str], ts: str, buckets: int):
        if ts not in keys:
            raise ValueError("the event time must be part of the load key")
        self.spark, self.keys, self.ts, self.buckets = spark, list(keys), ts, buckets
        self.columns = [f.name for f in schema]
        self.path = f"{path.rstrip('/')}/buckets-{buckets}"
        self.table = "load_target_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        cols = ", ".join(f"{_quoted(f.name)} {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(map(_quoted, self.keys))
        stored = _exists(spark, self.path)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} ({cols}, {DATE_COL} DATE) USING parquet PARTITIONED BY ({DATE_COL}) "
                  f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{self.path}'")
        if stored:  # a session that did not write it must learn its partitions
            spark.catalog.recoverPartitions(self.table)

    def rows(self) -> DataFrame:
        """The stored rows."""
        return self.spark.table(self.table).select(*map(_quoted, self.columns))

    def absent(self, firsts: DataFrame, span: tuple) -> DataFrame:
        """Rows of ``firsts`` (one per key, times inside ``span``) whose key is not stored.

        The target side has no exchange: its buckets are the join's
        partitions, and only the dates of ``span`` are read.
        """
        low, high = (F.lit(x) for x in span)
        target = (self.spark.table(self.table)
                  .filter(F.col(DATE_COL).between(F.to_date(low), F.to_date(high)) & F.col(self.ts).between(low, high))
                  .select(*map(_quoted, self.keys)))
        batch = firsts.repartition(self.buckets, *map(_quoted, self.keys))
        return batch.join(target.hint("merge"), self.keys, "left_anti")

    def insert(self, new: DataFrame, order_cols: Sequence[str]) -> dict:
        """Append the rows of ``new`` whose key is not stored yet; of a key repeated in the batch the first by ``order_cols``.

        A row with a NULL in a key column equals no stored row, as in a unique
        index; a NULL event time has no date to be found under and is refused.
        Returns ``{"total": n_in, "inserted": n_written}``.
        """
        path = scratch_path(self.spark, "batch")
        new.select(*map(_quoted, [*self.columns, *order_cols])).write.parquet(path)
        batch = self.spark.read.parquet(path)
        total, untimed, *span = batch.agg(F.count(F.lit(1)), F.count_if(F.col(self.ts).isNull()), F.min(self.ts), F.max(self.ts)).first()
        if not total:
            return {"total": 0, "inserted": 0}
        if untimed:
            raise ValueError(f"{untimed} rows without an event time in {self.ts}")
        n = Observation("inserted")
        # written first: the table must not be read and appended to by one job
        fresh = scratch_path(self.spark, "fresh")
        (self.absent(first_per_key(batch, self.keys, list(order_cols)), span).select(*map(_quoted, self.columns))
         .observe(n, F.count(F.lit(1)).alias("n")).write.parquet(fresh))
        rows = self.spark.read.parquet(fresh).withColumn(DATE_COL, F.to_date(self.ts))
        rows.repartition(self.buckets, *map(_quoted, self.keys)).sortWithinPartitions(DATE_COL, *map(_quoted, self.keys)) \
            .write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return {"total": int(total), "inserted": int(n.get["n"])}

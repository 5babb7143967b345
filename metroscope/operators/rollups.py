"""Hourly roll-ups that can be merged: late rows add a partial, nothing is recomputed.

A roll-up is a folder of batches.  Each batch stores, per key and hour, the
number of rows and of every measure the number of values, sum, minimum and
maximum; means are formed on reading, so partials of the same hour from any
number of batches add up to what one pass over all rows gives.  Distinct
counts are kept as bitmaps of numbers: a dictionary gives every value of the
counted column a number once, and an hour stores the bits of the numbers it
saw; bitmaps of hours and batches merge by OR.

Batches are stored under their id and a repeated batch replaces itself, so a
replayed load counts once.  ``compact`` folds all batches into one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metroscope.operators import sinks
from metroscope.operators.ranking import rank_within
from metroscope.streaming.landing import write_batch


def partials(df: DataFrame, ts: str, keys: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Per key and hour: n_rows and, of every measure m, n_m, sum_m, min_m, max_m."""
    aggs = [F.count(F.lit(1)).alias("n_rows")]
    for m in measures:
        aggs += [F.count(m).alias(f"n_{m}"), F.sum(m).alias(f"sum_{m}"), F.min(m).alias(f"min_{m}"), F.max(m).alias(f"max_{m}")]
    return df.groupBy(*keys, F.date_trunc("hour", ts).alias("hour")).agg(*aggs)


def merge(parts: DataFrame, by: Sequence[str | Column], measures: Sequence[str]) -> DataFrame:
    """The same columns with partials added up by ``by``."""
    aggs = [F.sum("n_rows").alias("n_rows")]
    for m in measures:
        aggs += [F.sum(f"n_{m}").alias(f"n_{m}"), F.sum(f"sum_{m}").alias(f"sum_{m}"), F.min(f"min_{m}").alias(f"min_{m}"), F.max(f"max_{m}").alias(f"max_{m}")]
    return parts.groupBy(*by).agg(*aggs) if by else parts.agg(*aggs)


class HourlyRollup:
    """Stored roll-up of a fact table at ``path`` (a shared folder).

    ``distinct`` names a column whose distinct values are counted per hour.
    """

    def __init__(self, spark: SparkSession, path: str, ts: str, keys: Sequence[str], measures: Sequence[str], distinct: str | None = None):
        self.spark, self.path, self.ts, self.keys, self.measures, self.distinct = spark, path, ts, list(keys), list(measures), distinct

    def _read(self, part: str) -> DataFrame | None:
        return self.spark.read.parquet(f"{self.path}/{part}") if sinks._exists(self.spark, f"{self.path}/{part}") else None

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Add the partials of ``rows``; a repeated ``batch_id`` replaces its own."""
        write_batch(partials(rows, self.ts, self.keys, self.measures), f"{self.path}/hours", batch_id)
        if self.distinct:
            numbered = self._numbered(rows, batch_id)
            bits = (numbered.groupBy(F.date_trunc("hour", self.ts).alias("hour"), F.bitmap_bucket_number("number").alias("bucket"))
                    .agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits")))
            write_batch(bits, f"{self.path}/bits", batch_id)

    def _numbered(self, rows: DataFrame, batch_id: int) -> DataFrame:
        """``rows`` with the dictionary number of the counted column (rows without a value are left out).

        A number, once given, never changes: other batches' bitmaps hold it.
        Only values without one are appended, so a repeated batch adds none.
        """
        c = self.distinct
        values = rows.filter(F.col(c).isNotNull()).select(c).distinct()
        known, top = self._read("numbers"), 0
        if known is not None:
            values = values.join(known.select(c), c, "left_anti")
            top = known.agg(F.max("number")).first()[0] or 0
        new = rank_within(values.withColumn("__all", F.lit(0)), ["__all"], [F.col(c)]).select(c, (F.col("rank") + top).cast("long").alias("number"))
        new.write.mode("append").parquet(f"{self.path}/numbers/batch_id={batch_id}")
        return rows.filter(F.col(c).isNotNull()).select(self.ts, c).join(self.spark.read.parquet(f"{self.path}/numbers").select(c, "number"), c)

    def _since(self, df: DataFrame, since) -> DataFrame:
        return df if since is None else df.filter(F.col("hour") >= (since if isinstance(since, Column) else F.lit(str(since)).cast("timestamp")))

    def hours(self, since=None) -> DataFrame:
        """One row per key and hour (from the hour ``since`` on): n_rows, and avg / min / max of every measure."""
        whole = merge(self._since(self._read("hours"), since), [*self.keys, "hour"], self.measures)
        return whole.select(*self.keys, "hour", "n_rows", *[c for m in self.measures for c in (
            (F.col(f"sum_{m}") / F.col(f"n_{m}")).alias(f"avg_{m}"), f"min_{m}", f"max_{m}")])

    def totals(self, since=None) -> DataFrame:
        """One row over all keys and hours: n_rows, n_distinct (if counted), and n / avg of every measure."""
        row = merge(self._since(self._read("hours"), since), [], self.measures)
        out = [F.coalesce("n_rows", F.lit(0)).alias("n_rows")]
        for m in self.measures:
            out += [F.coalesce(f"n_{m}", F.lit(0)).alias(f"n_{m}"), (F.col(f"sum_{m}") / F.col(f"n_{m}")).alias(f"avg_{m}")]
        if self.distinct:
            out.insert(1, F.coalesce(self.distinct_count([], since).select("n_distinct").scalar(), F.lit(0)).alias("n_distinct"))
        return row.select(*out)

    def distinct_count(self, by: Sequence[str] = ("hour",), since=None) -> DataFrame:
        """Exact number of distinct values, per hour or (``by=[]``) over all hours."""
        merged = self._since(self._read("bits"), since).groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        count = F.sum(F.bitmap_count("bits")).alias("n_distinct")
        return merged.groupBy(*by).agg(count) if by else merged.agg(count)

    def compact(self, path: str) -> HourlyRollup:
        """The roll-up folded into one batch at a new ``path``."""
        write_batch(merge(self._read("hours"), [*self.keys, "hour"], self.measures), f"{path}/hours", 0)
        if self.distinct:
            write_batch(self._read("bits").groupBy("hour", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")), f"{path}/bits", 0)
            write_batch(self._read("numbers").select(self.distinct, "number"), f"{path}/numbers", 0)
        return HourlyRollup(self.spark, path, self.ts, self.keys, self.measures, self.distinct)

"""Top-N rows per key, distributed even for a hot key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metroscope.operators.ranking import rank_within


def top_n_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  salt_buckets: int = 16, salt_cols: Sequence[str] | None = None) -> DataFrame:
    """Keep the first ``n`` rows of every key in ``order`` (which must be a
    total order), numbered 1..n in ``rank``.

    Two phases: rows are first ranked inside (key, salt) slices, where the
    salt is a hash of ``salt_cols`` (default: all columns) spread over
    ``salt_buckets``; only each slice's top ``n`` survive, so a key holding a
    third of all rows is cut down by many tasks in parallel.  The final
    ranking then sees at most ``salt_buckets * n`` rows per key.
    ``n <= 0`` keeps every row, ranked in slices (``rank_within``).
    """
    keys = list(keys)
    if n <= 0:
        return rank_within(df, keys, order)
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in (salt_cols or df.columns)]), F.lit(salt_buckets))
    s = df.withColumn("__salt", salt)
    s = s.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, "__salt").orderBy(*order)))
    s = s.filter(F.col("__r") <= n).drop("__r", "__salt")
    s = s.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return s.filter(F.col("rank") <= n)

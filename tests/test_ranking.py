"""Distributed ranking and top-N against plain windows, on a hot key."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from metroscope.operators.ranking import rank_within
from metroscope.operators.topn import top_n_per_key


def _skewed(spark):
    # one group holds about a third of the rows; scores repeat to exercise ties
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"),
                                  (F.col("id") % 17).cast("double").alias("score"), F.col("id").alias("pos"))
    return df


def test_rank_within_equals_row_number(spark):
    df = _skewed(spark)
    order = [F.col("score").desc(), F.col("pos")]
    got = {(r.g, r.pos): r.rank for r in rank_within(df, ["g"], order, partitions=7).collect()}
    want = {(r.g, r.pos): r.rn for r in df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order))).collect()}
    assert got == want


def test_top_n_per_key(spark):
    df = _skewed(spark)
    order = [F.col("score").asc(), F.col("pos")]
    got = sorted((r.g, r.pos, r.rank) for r in top_n_per_key(df, ["g"], order, 5, salt_buckets=6).collect())
    w = df.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).filter("rank <= 5")
    assert got == sorted((r.g, r.pos, r.rank) for r in w.collect())


@pytest.mark.parametrize("rows, parts, slices", [(100_000, 1, 4), (100_000, 8, 200), (100_000, 200, 8), (1_000_000, 8, 8)])
def test_ranks_equal_row_number_beyond_the_bounds_sample(spark, rows, parts, slices):
    """Large enough that range bounds are sampled; one group holds a third of the rows."""
    df = spark.range(rows, numPartitions=parts).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 3 == 1, F.concat(F.lit("g"), (F.col("id") % 50).cast("string"))).alias("g"),
        F.xxhash64("id").alias("v"), "id")
    got = rank_within(df, ["g"], [F.col("v").desc(), F.col("id")], partitions=slices)
    want = df.select("id", F.row_number().over(Window.partitionBy("g").orderBy(F.col("v").desc(), "id")).alias("w"))
    r = got.join(want, "id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rank") == F.col("w")).alias("same")).first()
    assert (r.n, r.same) == (rows, rows)

"""Row numbering inside groups that stays distributed for hot groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metroscope.session import ensure_checkpoint_dir


def rank_within(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column], out: str = "rank",
                partitions: int | None = None) -> DataFrame:
    """1-based position of each row inside its group by ``order`` (a total
    order).

    Rows are range-partitioned on (group, order), so a group holding a third
    of all rows spans many tasks; each task numbers its slice, and the slice
    sizes (one small row per task and group) give the offsets, joined back.
    The slices are checkpointed with their number before they branch: both
    branches then read the same files, whatever the optimizer makes of them
    and whichever executor is lost.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    groups = [F.col(g) for g in group_cols]
    parted = df.repartitionByRange(n, *groups, *order).withColumn("__part", F.spark_partition_id()).checkpoint()
    local_w = Window.partitionBy("__part", *group_cols).orderBy(*order)
    counts = parted.groupBy("__part", *group_cols).agg(F.count(F.lit(1)).alias("__cnt"))
    parted = parted.withColumn("__local", F.row_number().over(local_w))
    offs_w = Window.partitionBy(*group_cols).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(offs_w), F.lit(0))).drop("__cnt")
    offsets = offsets.select(F.col("__part").alias("__opart"), *[F.col(g).alias(f"__o_{g}") for g in group_cols], "__off")
    # group keys may be NULL: match them null-safely
    cond = F.col("__part") == F.col("__opart")
    for g in group_cols:
        cond = cond & F.col(g).eqNullSafe(F.col(f"__o_{g}"))
    return (parted.join(offsets, cond)
            .withColumn(out, (F.col("__local") + F.col("__off")).cast("int"))
            .drop("__part", "__local", "__off", "__opart", *[f"__o_{g}" for g in group_cols]))

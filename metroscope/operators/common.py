"""Small shared helpers: checked broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.session import ensure_checkpoint_dir

# Dimension rows allowed in a broadcast hash join (the line reference holds
# about two thousand rows; the bound leaves room for growth).
DIMENSION_BROADCAST_MAX_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame, max_rows: int = DIMENSION_BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast ``df`` only when its row count is proven <= ``max_rows``.

    Above the bound the join is left to the planner (sort-merge, or an AQE
    runtime broadcast that Spark itself sizes).
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def materialize(df: DataFrame) -> DataFrame:
    """Write a small derived table (a snapshot: one row per sensor) once to
    the shared checkpoint folder; later reads skip its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored_copy(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back as a plain
    table, for a result that several branches of one query read."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/copies/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BARRIER_COL = "__task"


def planned_partitions(df: DataFrame) -> int:
    """Tasks that will produce ``df``, read from the physical plan."""
    return df._jdf.queryExecution().sparkPlan().outputPartitioning().numPartitions()


def spread(df: DataFrame, barrier: bool = False) -> DataFrame:
    """Give heavy row-local work (JSON parsing, distance scans) at least one
    task per core.

    A small input file is a single split, so one task would do all the work.
    Inputs that already have enough partitions (any large scan) are returned
    unchanged: no shuffle is added at scale.  The partition count is read from
    the physical plan; nothing is executed.

    With ``barrier`` the result carries a ``__task`` column (the task id, a
    non-deterministic value): filters of the heavy work above it are then not
    pushed below the exchange into the single-task map side.  The caller
    keeps the column until after its filters and drops it.
    """
    if df.isStreaming:  # a stream's parallelism comes from its source and trigger
        return df
    want = df.sparkSession.sparkContext.defaultParallelism
    if planned_partitions(df) >= want:
        return df
    out = df.repartition(want)
    return out.withColumn(BARRIER_COL, F.spark_partition_id()) if barrier else out


def barrier_holds(df: DataFrame):
    """Always-true condition on the barrier column (TRUE when absent)."""
    return (F.col(BARRIER_COL) >= 0) if BARRIER_COL in df.columns else F.lit(True)


def with_barrier(df: DataFrame) -> DataFrame:
    """Add the barrier column (task id) to a DataFrame, e.g. at the end of an
    input builder that already runs spread out."""
    return df if BARRIER_COL in df.columns else df.withColumn(BARRIER_COL, F.spark_partition_id())

"""Raw responses: landed files, and the archive partitioned by source and date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
OPEN_FILES = 100


def read_bronze(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, raw)`` rows, one per landed file (a whole, possibly
    indented JSON document each); no schema inference."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("raw")))


def one_line(raw: Column) -> Column:
    """The text with every run of line breaks as one space; a text without any is passed as it is."""
    broken = raw.contains("\n") | raw.contains("\r")
    return F.when(broken, F.regexp_replace(raw, r"[\r\n]+", " ")).otherwise(raw)


def write_bronze(df: DataFrame, path: str, partition_cols=("source", "ingest_date")) -> None:
    """Archive raw JSON responses, one document a line, partitioned by source
    and ingest date; appends never rewrite earlier partitions.

    Line breaks between members become spaces (inside JSON strings they are
    escaped already), so millions of small responses share few files.  A task
    keeps up to ``OPEN_FILES`` files open and writes its rows as they come;
    only rows of further partitions are sorted.
    """
    spark = df.sparkSession
    before = spark.conf.get(WRITERS, None)
    spark.conf.set(WRITERS, OPEN_FILES)
    try:
        df.select(one_line(F.col("raw")).alias("raw"), *partition_cols).write.mode("append").partitionBy(*partition_cols).text(path)
    finally:
        spark.conf.unset(WRITERS) if before is None else spark.conf.set(WRITERS, before)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``(raw, source, ingest_date)``: the documents ``write_bronze`` stored."""
    return (spark.read.option("recursiveFileLookup", "false").text(path)
            .select(F.col("value").alias("raw"), "source", F.col("ingest_date").cast("string").alias("ingest_date")))


def archive_name(stop_id, ts) -> Column:
    """File name of an archived stop response: ``prim_``, the stop id with ``:``
    as ``_`` and no ``_`` at its ends, the time, ``.json``."""
    stop = F.trim(F.replace(stop_id, F.lit(":"), F.lit("_")), F.lit("_"))
    return F.concat(F.lit("prim_"), stop, F.lit("_"), F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit(".json"))

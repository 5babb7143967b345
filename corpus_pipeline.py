"""Corpus preparation as five stages over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes
it as Parquet to the shared checkpoint folder and hands the reread table to
the next stage, so a lost executor never recomputes an earlier stage.  All
stages but the last return the columns of documents.

* quality: documents the classifier scores below its acceptance bound go; it
  learns from labels of the training remainder only.
* exact_dedup: of texts equal up to A-Z case the largest doc_id stays.
* near_dedup: of a class of near-duplicates the smallest doc_id stays; texts
  without words stay.
* decontaminate: word ranges that the benchmark's windows cover are cut out of
  the text (n_chars follows); a document of which nothing is left goes; others
  are unchanged.
* pack: one row per piece of the packed token sequences.

Nulls, empty texts and tables, repeated rows and further columns are handled
as each operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from metroscope.llm import decontaminate, exact_dedup, near_dedup, packing, quality, runtime
from metroscope.llm.queries import buckets, tokenizer_path

ORACLE_SQL = None  # the classifier, signatures and tokenizer have no SQL form


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accept(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(docs, exact_dedup.DigestIndex(spark, runtime.scratch(spark, "digest-index"), buckets(spark)))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_spans(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_path(), end_id=1, added=True)


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("pack", pack_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; the rows of the last one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = runtime.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs

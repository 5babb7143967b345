"""Labelled training rows for the classifiers: which rows may teach, and a bounded sample of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metroscope.llm.runtime import doc_text

SAMPLE = 16_000  # labelled rows a classifier is fitted on, at most


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, text, y) of at most ``sample`` labelled documents outside the held-out remainder.

    The rows with the smallest hashed doc_ids are taken, so the choice does
    not depend on order or partitioning.  Null labels do not count; a
    doc_id labelled twice has the rounded mean of its labels.  Of rows that
    repeat a chosen doc_id the one with the smallest text hash is taken (found
    within each task first), so the bound holds for rows too.
    """
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
              .filter((remainder("doc_id", modulus) != held) & F.col("y").isNotNull() & F.col("doc_id").isNotNull())
              .groupBy("doc_id").agg(F.round(F.avg("y")).cast("int").alias("y"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    # at most `sample` rows of two numbers: a proven bound
    rows = doc_text(docs).join(F.broadcast(chosen), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("row"))
    return one.select("doc_id", F.col("row.text").alias("text"), "y")

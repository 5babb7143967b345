"""Exact deduplication against a persistent digest index (native).

The index is a parquet table of one row per distinct text, bucketed and sorted
by the SHA-256 of the normalised text.  A batch is reduced to one row per
digest (partial aggregates, so a text copied a million times is one row before
the shuffle), anti-joined with the index bucket by bucket, and the unseen rows
are appended.  Only DataFrame functions are used.

Defined cases: a null text counts as the empty text; texts are equal when they
are identical after lower-casing A-Z only; of equal texts in a batch the row
with the largest doc_id stays (a null doc_id is the smallest); a text already
in the index stays with the doc_id recorded there; rows that repeat a doc_id
with an equal text are one document; other columns, whatever their names, pass
through unchanged; an empty table gives empty results.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metroscope.llm.runtime import quoted, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: str | Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed; null as empty."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("string")
    # a text without multi-byte characters takes the fast path; both give the same string
    return F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def digest(text: str | Column) -> Column:
    return F.sha2(normalised(text), 256)


def row_key(digest: str | Column, doc_id: str | Column) -> Column:
    """Digest and doc_id as one string: 64 hex digits, then ``:`` and the id if there is one."""
    return F.concat_ws(":", digest, (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"))


class DigestIndex:
    """The digest index stored at ``path`` (a shared folder).

    ``buckets`` is fixed when the index is created and must be given again
    when it is opened; it is part of the folder name, so a different number
    never reads foreign buckets.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.buckets = spark, buckets
        self.path = f"{path.rstrip('/')}/buckets-{buckets}"
        self.table = "digest_index_" + hashlib.md5(self.path.encode()).hexdigest()[:16]
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.table} (digest STRING, keep_id BIGINT, group_size BIGINT) USING parquet "
                  f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def bucketed(self) -> DataFrame:
        """The index as a bucketed table: joins on ``digest`` read it without a shuffle."""
        return self.spark.table(self.table)

    def rows(self) -> DataFrame:
        """The same rows as plain files, for joins that must be free to split a hot digest."""
        return self.spark.read.schema(self.bucketed().schema).parquet(self.path)

    def add(self, keyed: DataFrame) -> DataFrame:
        """Append the digests of ``keyed`` (doc_id, digest) that are not in the index yet.

        Returns the appended rows (digest, keep_id, group_size).
        """
        # stored first: the optimizer would push the anti-join below the aggregate, onto all copies of a hot text
        groups = stored(keyed.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        fresh = stored(groups.join(self.bucketed().select("digest").hint("merge"), "digest", "left_anti"), "fresh-digests")
        fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.table)
        self.spark.catalog.refreshTable(self.table)
        return fresh


def keys(docs: DataFrame) -> DataFrame:
    """(doc_id, digest) of every row, stored once: the text is read and hashed a single time."""
    return stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest")), "digests")


def decisions(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keyed = keys(docs)
    index.add(keyed)
    # both sides are shuffled, so adaptive execution can split the rows of a hot digest
    return (keyed.join(index.rows().hint("merge"), "digest")
            .select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                    F.col("digest").alias("text_sha256")))


def deduplicate(docs: DataFrame, index: DigestIndex) -> DataFrame:
    """The documents of ``docs`` whose text is new to the index, one row for each text, all columns.

    The join key holds the doc_id beside the digest, so the rows of one much
    copied text spread over all tasks.  It is one string that is never null:
    the join adds no filter that would hash each text again, and its shuffle
    and sort, the only ones whole rows go through, serve the removal of
    repeated rows too.
    """
    fresh = index.add(keys(docs))
    names = docs.columns
    # a clash-free helper column: no input column can have the same name
    mark = "__k" + hashlib.md5("|".join(names).encode()).hexdigest()[:8]
    left = docs.withColumn(mark, row_key(digest("text"), F.col("doc_id").cast("long")))
    right = fresh.select(row_key("digest", "keep_id").alias(mark))
    # repeated rows of a kept doc_id fall together here
    return left.join(right.hint("merge"), mark, "left_semi").dropDuplicates([mark]).select(*map(quoted, names))

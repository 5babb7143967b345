"""Many-needle substring search over trigram posting lists.

Every position of a text starts a gram of up to three characters (shorter ones
at its end), so a needle of three or more characters lies only in texts that
hold all its trigrams, and a shorter one only in texts with a gram that starts
with it.  A needle reads the postings of its rarest trigram alone; the texts
found are then checked, so the result is exactly ``contains``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metroscope.operators.sinks import scratch_path

GRAM = 3


def _lowered(col: str):
    return F.lower(F.coalesce(F.col(col).cast("string"), F.lit("")))


class SubstringIndex:
    """Posting lists of distinct lower-cased texts, stored in a folder.

    ``texts`` (text_key, text), ``postings`` (gram, text_key) in gram order, so
    a gram's rows lie in few row groups, and ``grams`` (gram, n).  A text is
    known by its 64-bit hash in the postings; two texts that share one are both
    checked, so a collision costs a comparison and changes no result.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, items: DataFrame, cols: Sequence[str], path: str | None = None) -> "SubstringIndex":
        spark = items.sparkSession
        index = cls(spark, path or scratch_path(spark, "substrings"))
        several = items.select(F.explode(F.array(*[_lowered(c) for c in cols])).alias("text"))
        texts = several.filter("text <> ''").distinct().select(F.xxhash64("text").alias("text_key"), "text")
        texts.write.parquet(f"{index.path}/texts")
        places = F.sequence(F.lit(1), F.length("text"))
        grams = F.array_distinct(F.transform(places, lambda p: F.substring(F.col("text"), p, F.lit(GRAM))))
        postings = index.texts().select(F.explode(grams).alias("gram"), "text_key").distinct()
        postings.repartitionByRange("gram", "text_key").sortWithinPartitions("gram").write.parquet(f"{index.path}/postings")
        index.postings().groupBy("gram").agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{index.path}/grams")
        return index

    def texts(self) -> DataFrame:
        return self.spark.read.schema("text_key long, text string").parquet(f"{self.path}/texts")

    def postings(self) -> DataFrame:
        return self.spark.read.schema("gram string, text_key long").parquet(f"{self.path}/postings")

    def grams(self) -> DataFrame:
        return self.spark.read.schema("gram string, n long").parquet(f"{self.path}/grams")

    def search(self, needles: DataFrame, col: str) -> DataFrame:
        """(needle, text): every distinct lower-cased needle with each stored text that contains it.

        NULL and empty needles match nothing.
        """
        n = needles.select(_lowered(col).alias("needle")).filter("needle <> ''").distinct()
        size = F.length("needle")
        starts = F.sequence(F.lit(1), size - (GRAM - 1))
        own = n.filter(size >= GRAM).select("needle", F.explode(F.array_distinct(
            F.transform(starts, lambda p: F.substring(F.col("needle"), p, F.lit(GRAM))))).alias("gram"))
        # a trigram without postings has n = 0, is the rarest and finds nothing
        counted = own.join(self.grams(), "gram", "left").select("needle", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
        rarest = counted.groupBy("needle").agg(F.min("g").alias("g")).select("needle", F.col("g.gram").alias("gram"))
        heads = self.grams().select("gram", F.explode(F.array_distinct(F.array(
            *[F.substring("gram", 1, k) for k in range(1, GRAM)]))).alias("needle"))
        short = n.filter(size < GRAM).join(heads, "needle").select("needle", "gram")
        candidates = rarest.unionByName(short).join(self.postings(), "gram").select("needle", "text_key").distinct()
        found = candidates.join(self.texts(), "text_key").filter(F.contains("text", "needle"))
        return found.select("needle", "text").distinct()


def matches(keys: DataFrame, key_col: str, items: DataFrame, item_cols: Sequence[str],
            index: SubstringIndex | None = None) -> DataFrame:
    """Pairs (key row, item row), each once, where lower(key) is contained in
    lower(coalesce(item_col, '')) for any of ``item_cols``; NULL and empty keys
    match nothing.  ``index`` may hold more texts than these items'."""
    index = index or SubstringIndex.build(items, item_cols)
    pairs = index.search(keys, key_col).withColumnsRenamed({"needle": "__needle", "text": "__text"})
    texts = F.array_distinct(F.array(*[_lowered(c) for c in item_cols]))
    rows = items.distinct().select(*[F.col("`" + c.replace("`", "``") + "`") for c in items.columns], F.explode(texts).alias("__text"))
    hit = keys.distinct().withColumn("__needle", _lowered(key_col)).join(pairs, "__needle").join(rows, "__text")
    return hit.drop("__needle", "__text").dropDuplicates([*keys.columns, *items.columns])

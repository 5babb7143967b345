"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metroscope.llm import decontaminate, divergence, exact_dedup, license_scan, line_dedup, lm_bloom, near_dedup, packing, quality, runtime, substring_dedup, token_store, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def buckets(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


@register("op1_exact_dedup", """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
     h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM h WINDOW g AS (PARTITION BY text_sha256)""")
def op1(spark: SparkSession, d: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, runtime.scratch(spark, "digest-index"), buckets(spark))
    return exact_dedup.decisions(documents(spark, d), index)


@register("op2_packing")
def op2(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(documents(spark, d), tokenizer_path(), end_id=1, added=True)


@register("op7_token_store")
def op7(spark: SparkSession, d: str) -> DataFrame:
    path = runtime.scratch(spark, "token-store")
    token_store.write(documents(spark, d), path, tokenizer_path(), end_id=2, added=True)
    return token_store.Store(spark, path).documents()


@register("op3_near_dedup")
def op3(spark: SparkSession, d: str) -> DataFrame:
    return near_dedup.groups(documents(spark, d))


@register("op4_toxicity")
def op4(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{d}/labels.parquet")))


@register("op5_quality")
def op5(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    return quality.score(docs, quality.train(docs, spark.read.parquet(f"{d}/labels.parquet")))


@register("op6_lm_bloom")
def op6(spark: SparkSession, d: str) -> DataFrame:
    return lm_bloom.score(documents(spark, d))


@register("op8_decontamination", f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
     items AS (SELECT item_id, array_to_string(w[s:s + 9], ' ') AS g, least(10, len(w)) AS n
               FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS s FROM b WHERE len(w) > 0)),
     sizes AS (SELECT DISTINCT n FROM items),
     grams AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g
               FROM (SELECT doc_id, w, n, unnest(range(1, greatest(0, len(w) - n + 1) + 1)) AS s FROM d, sizes)),
     hits AS (SELECT doc_id, s, n, g FROM grams SEMI JOIN items USING (g, n)),
     words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
     found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
               FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits JOIN items USING (g, n)) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)""")
def op8(spark: SparkSession, d: str) -> DataFrame:
    return decontaminate.report(decontaminate.find(documents(spark, d), spark.read.parquet(f"{d}/benchmark.parquet")))


@register("op9_license_scan")
def op9(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.scan(documents(spark, d))


@register("op10_substring_dedup", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
     win AS (SELECT doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS g
             FROM (SELECT doc_id, w, unnest(range(1, greatest(0, len(w) - 49) + 1)) AS s FROM d)),
     first AS (SELECT g, min(doc_id) AS first_id FROM win GROUP BY g),
     gone AS (SELECT DISTINCT doc_id, unnest(range(s, s + 50)) AS p FROM win JOIN first USING (g) WHERE first_id < doc_id),
     word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op10(spark: SparkSession, d: str) -> DataFrame:
    found = substring_dedup.remove_repeats(documents(spark, d))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op11_source_divergence", r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
     tok AS (SELECT doc, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                 '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
     kept AS (SELECT lang, term, count(*) AS n FROM tok GROUP BY lang, term HAVING count(DISTINCT doc) >= 3),
     grp AS (SELECT DISTINCT lang, source FROM d),
     cnt AS (SELECT lang, source, term, count(*) AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
     lt AS (SELECT lang, CAST(sum(n) AS BIGINT) AS total, count(*) AS v FROM kept GROUP BY lang),
     gt AS (SELECT lang, source, CAST(coalesce(sum(n), 0) AS BIGINT) AS total FROM grp LEFT JOIN cnt USING (lang, source) GROUP BY lang, source),
     p AS (SELECT gt.lang, gt.source, kept.term, coalesce(cnt.n, 0) AS n, 1 + 1000000000 * (coalesce(cnt.n, 0) + 1) // (gt.total + lt.v) AS p,
                  1 + 1000000000 * (kept.n + 1) // (lt.total + lt.v) AS q
           FROM gt JOIN lt USING (lang) JOIN kept USING (lang) LEFT JOIN cnt ON cnt.lang = gt.lang AND cnt.source = gt.source AND cnt.term = kept.term),
     sums AS (SELECT a.lang, a.source, b.source AS item, CAST(sum((a.p - b.p) * (a.p - b.p) // b.p) AS BIGINT) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
     pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
               FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
               LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
     terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
     ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (FROM pairs UNION ALL FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200""")
def op11(spark: SparkSession, d: str) -> DataFrame:
    return divergence.audit(documents(spark, d))


@register("op12_line_dedup", r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
     line AS (SELECT doc_id, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS i FROM d),
     keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
                                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
     often AS (SELECT k, max(doc_id) AS keep FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(line, chr(10) ORDER BY i) AS t
              FROM keyed LEFT JOIN often USING (k) WHERE keep IS NULL OR keep = doc_id GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, len(l) - coalesce(n, 0) AS n_dropped, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)""")
def op12(spark: SparkSession, d: str) -> DataFrame:
    docs = documents(spark, d)
    found = line_dedup.drop_lines(docs, line_dedup.LineIndex(docs))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@register("op13_vector_codes", """
WITH kept AS (
       SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS r,
              list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v, len(embedding) // 16 AS w
       FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     cut AS (SELECT r, p, v[p * w + 1:(p + 1) * w] AS x FROM kept, range(16) AS t(p)),
     first AS (SELECT p, r - 1 AS e, x AS c FROM cut WHERE r <= 64),
     near0 AS (SELECT r, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) % 64 AS e FROM cut JOIN first USING (p) GROUP BY r, p),
     sums0 AS (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near0 JOIN cut USING (r, p), range(1, 1 + (SELECT max(w) FROM kept)) AS t(i) GROUP BY p, e, i),
     mean0 AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums0 GROUP BY p, e),
     books1 AS (SELECT p, e, coalesce(mean0.c, first.c) AS c FROM first LEFT JOIN mean0 USING (p, e)),
     near1 AS (SELECT r, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) % 64 AS e FROM cut JOIN books1 USING (p) GROUP BY r, p),
     sums1 AS (SELECT p, e, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM near1 JOIN cut USING (r, p), range(1, 1 + (SELECT max(w) FROM kept)) AS t(i) GROUP BY p, e, i),
     mean1 AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM sums1 GROUP BY p, e),
     books2 AS (SELECT p, e, coalesce(mean1.c, books1.c) AS c FROM books1 LEFT JOIN mean1 USING (p, e)),
     near2 AS (SELECT r, p, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) * 64 + e) AS m FROM cut JOIN books2 USING (p) GROUP BY r, p),
     coded AS (SELECT r, string_agg(lpad(lower(to_hex(CAST(m % 64 AS BIGINT))), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m // 64) AS BIGINT) AS error FROM near2 GROUP BY r),
     books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM books2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (r), books""")
def op13(spark: SparkSession, d: str) -> DataFrame:
    return vector_codes.report(vector_codes.VectorCodes(spark.read.parquet(f"{d}/embeddings.parquet")))

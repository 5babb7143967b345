"""Source divergence against a plain-Python twin, with and without colliding digests."""

import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from metroscope.llm import divergence as D

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, min_docs=3, top=200):
    """docs: (text, lang, source)"""
    n, df, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        found = TERM.findall(H.low(text))
        groups[lang].add(source)
        n[lang, source].update(found)
        df[lang].update(set(found))
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for t, k in df[lang].items() if k >= min_docs)
        whole = {t: sum(n[lang, s][t] for s in sources) for t in kept}

        def shares(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 1) // (total + len(kept)) for t in kept}
        p, q = {s: shares(n[lang, s]) for s in sources}, shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = sorted((-sum(f(p[s][t], p[r][t]) for t in kept), r) for r in sources if r != s)
            terms = sorted((-f(p[s][t], q[t]), t) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, item, -v, i + 1) for part, rows in (("pair", pairs), ("term", terms)) for i, (v, item) in enumerate(rows)]
    return sorted(out)


def corpus(seed=5, n=240):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("alpha", "Béta", "数字", "gamma", "delta", "longword" * 3, "x") for b in ("", "o", "ar", "ing", "Ed", "ö", "zzzzzzzz", "k")]
    docs = []
    for i in range(n):
        lang, source = rng.choice(["en", "de", None]), rng.choice(["web", "web", "web", "book", "", None, "forum"])
        shift = len(source or "") * 7
        docs.append((" ".join(words[(int(rng.expovariate(0.08)) + shift) % len(words)] + rng.choice(["", ".", "1", " 22 ", "-"]) for _ in range(rng.randint(0, 40))), lang, source))
    docs += [(None, "en", "silent"), ("", "fr", "a"), ("123 ...", "fr", "b"), (" ".join("once%s" % chr(97 + i) for i in range(26)), "en", "web"), (H.LONG, "en", "long")]
    return docs + docs[:20]


def table(spark, docs):
    return spark.createDataFrame([(i, t, la, s, "x", 0) for i, (t, la, s) in enumerate(docs)], "doc_id long, text string, lang string, source string, grp string, digest long")


def found(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def test_audit_equals_brute_force(spark):
    docs = corpus()
    assert found(D.audit(table(spark, docs).repartition(5))) == brute(docs)


def test_colliding_digests_split_exactly(spark):
    docs = corpus(7, 120)
    own = table(spark, docs).repartition(3)
    assert D.SourceTerms(own, bits=5).split > 5
    assert found(D.audit(own, bits=5, top=9)) == brute(docs, top=9)


@pytest.mark.parametrize("docs", [[], [(None, None, None)], [("", "fr", "a"), ("x", "fr", "b")]])
def test_tables_without_kept_terms(spark, docs):
    assert found(D.audit(table(spark, docs))) == brute(docs)


def test_true_collisions_of_full_digests_are_noticed(spark):
    """A block in which two different strings carry one 64-bit digest (made up: real ones are not at hand)."""
    import pyarrow as pa

    from metroscope.llm.words import split
    w = split(pa.array(["aa bb aa cc bb"]), "letters")
    raw = w.buf.tobytes()
    terms = {}
    D._note(terms, np.array([1, 2]), np.array([0, 3]), np.array([0, 0, 0, 1, 0]), w, raw)
    assert terms == {1: (b"aa", b"bb"), 2: (b"cc", b"cc")}


def test_shares_are_exact_beyond_64_bit_products():
    rng = random.Random(1)
    total = [rng.randint(1, 9 * 10**13) for _ in range(2000)]
    count = [rng.randint(0, t - 1) for t in total]
    got = D.shares(np.array(count), np.array(total))
    assert got.tolist() == [1 + 10**9 * (c + 1) // t for c, t in zip(count, total)]


def test_a_task_sends_one_row_for_each_term_of_a_language(spark):
    """However many sources have the term: their counts travel in that row."""
    docs = [(f"one two three {s}", lang, f"source{k}") for k, s in enumerate("abcdefgh") for lang in ("en", "de")] * 3
    own = table(spark, docs).coalesce(1)
    rows = D.term_rows(D.numbered(own, D.groups_of(own)), 64).collect()
    assert sorted((r.lang, r.name) for r in rows) == sorted((k, t) for k in (1, 2) for t in ["one", "two", "three", *"abcdefgh"])
    assert {r.name: r.df for r in rows} == {"one": 24, "two": 24, "three": 24} | dict.fromkeys("abcdefgh", 3)


@pytest.mark.parametrize("at_once", [1, 2, 5, 10**6])
def test_terms_cut_by_batches_are_added_up_whole(at_once):
    import pyarrow as pa
    rng = random.Random(3)
    packed = lambda pairs: np.array(pairs, D.PACKED).tobytes()
    rows = sorted((rng.randint(-9, 9), rng.randint(1, 2), rng.choice(["a", "bb", "lengthy" * 4]), rng.randint(0, 3), tuple((g, rng.randint(1, 99)) for g in sorted(rng.sample(range(1, 6), rng.randint(1, 4)))))
                  for _ in range(200))
    batches = [pa.RecordBatch.from_arrays([pa.array([r[1] for r in part], pa.int32()), pa.array([r[0] for r in part]), pa.array([r[2] for r in part]), pa.array([r[3] for r in part]),
                                           pa.array([packed(list(r[4])) for r in part], pa.binary())], ["lang", "digest", "name", "df", "packed"]) for part in (rows[i:i + 3] for i in range(0, 200, 3))]
    got = [r for b in D._in_order(iter(batches), ["digest", "lang"], 4, at_once) for r in b.to_pylist()]
    want = defaultdict(lambda: [0, [], Counter()])
    for digest, lang, name, df, pairs in rows:
        held = want[digest, lang]
        held[0] += df
        held[1].append(name)
        held[2].update(dict(pairs))
    assert [(r["digest"], r["lang"], r["low"], r["high"], {g["grp"]: g["n"] for g in r["by_group"]}, r["lang_n"]) for r in got] == [
        (d, k, min(names), max(names), dict(n), sum(n.values())) for (d, k), (df, names, n) in sorted(want.items()) if df >= 4]


def test_shares_in_64_bits_equal_those_in_decimals(spark):
    from pyspark.sql import functions as F
    rng = random.Random(8)
    rows = [(n, t, v) for t in [1, 7, 10**5, 10**9 + 7, 10**13, 9 * 10**13 - 1, 9 * 10**13, 10**17] for v in (1, 5) for n in {0, 1, t // 3, t - 1, t, rng.randint(0, t)} if n <= t]
    df = spark.createDataFrame(rows, "n long, t long, v long")
    assert [r.p for r in df.select(D.share(F.col("n"), F.col("t"), F.col("v")).alias("p")).collect()] == [1 + 10**9 * (n + 1) // (t + v) for n, t, v in rows]

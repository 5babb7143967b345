"""Substring index: equal to ``contains`` on random texts, one gram read per needle."""

import random

from metroscope.operators import substrings


def test_equals_contains_on_random_texts(spark):
    r = random.Random(3)
    word = lambda a, b: "".join(r.choice("abÉé c%_") for _ in range(r.randrange(a, b)))
    items = [(i, word(0, 30) if i % 7 else None, word(0, 12) if i % 5 else None) for i in range(300)] + [(300, "x" * 5000 + "needle", "")]
    needles = [word(0, 6) for _ in range(80)] + ["needle", "zzz", "x", "", None, "É", "a", "xxn"]
    idf = spark.createDataFrame(items, "i int, name string, code string")
    kdf = spark.createDataFrame([(n,) for n in needles], "k string")
    got = sorted((x.k, x.i) for x in substrings.matches(kdf, "k", idf, ["name", "code"]).collect())
    want = sorted({(n, i) for n in needles if n for i, a, b in items
                   if n.lower() in (a or "").lower() or n.lower() in (b or "").lower()})
    assert got == want


def test_empty_sides(spark):
    none = spark.createDataFrame([], "k string")
    items = spark.createDataFrame([("abc",)], "name string")
    assert substrings.matches(none, "k", items, ["name"]).count() == 0
    assert substrings.matches(items, "name", none, ["k"]).count() == 0


def test_stored_index_serves_several_searches(spark):
    items = spark.createDataFrame([("Châtelet",), ("La Défense",), ("Gare de Lyon",)], "name string")
    index = substrings.SubstringIndex.build(items, ["name"])
    again = substrings.SubstringIndex(spark, index.path)
    for q, want in (("DÉF", ["la défense"]), ("e", ["châtelet", "gare de lyon", "la défense"]), ("lyons", [])):
        found = again.search(spark.createDataFrame([(q,)], "q string"), "q")
        assert sorted(x.text for x in found.collect()) == want
    # narrow rows: no copy of the text per gram or length
    assert index.postings().columns == ["gram", "text_key"]
    assert index.postings().groupBy("gram", "text_key").count().filter("count > 1").count() == 0

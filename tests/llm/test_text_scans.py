"""Benchmark decontamination and license scans against brute force."""

import hashlib
import sys
from pathlib import Path

import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from metroscope.llm import decontaminate as D
from metroscope.llm import license_scan as L

ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Short ITEM"), (3, None), (4, "..."),
         (10, "one two three four five six seven eight nine ten"), (11, "déjà vu là-bas"), (None, "no id words")]
CASES = H.TEXTS + [
    (20, "before One, two THREE four-five six seven eight nine ten eleven twelve after"), (21, "a short item and Short. Item!"),
    (22, "one two three four five six seven eight nine"), (23, "short item"), (24, "DÉJÀ vu là bas, déjà vu LÀ bas"),
    (25, " ".join(["one two three four five six seven eight nine ten eleven twelve"] * 40)), (26, "no id words")]


def _benchmark(spark):
    return spark.createDataFrame(ITEMS, "item_id long, text string")


@pytest.mark.parametrize("block_words", [1_000_000, 4])
def test_decontamination_equals_brute_force(spark, block_words):
    found = D.report(D.find(H.awkward(spark, CASES), _benchmark(spark), block_words=block_words)).collect()
    want = []
    for i, words, hit, items in H.contamination(CASES, ITEMS):
        items = [x for x in items if x != "None"]
        want.append((i, words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))


def test_hit_ranges_are_cut_and_clean_rows_are_untouched(spark):
    docs = H.awkward(spark, CASES)
    out = D.remove_spans(docs, _benchmark(spark))
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_chars))
    assert got[20] == [("before\nafter", 12)]
    assert 23 not in got and 25 not in got and 26 not in got  # nothing left
    assert got[24][0][0] == dict(CASES[-6:])[24]  # only A-Z is lower-cased: no match
    for i, t in H.TEXTS:
        assert (t, len(t or "")) in got[i]
    again = H.contamination([(i, t) for i, rows in got.items() for t, _ in rows], ITEMS)
    assert all(hit == 0 for _, _, hit, _ in again)


def test_blocks_of_phrases_cut_the_same_ranges_and_hold_one_broadcast(spark, monkeypatch):
    docs = H.awkward(spark, CASES)
    rows = lambda df: sorted(((r.doc_id, r.text, r.n_chars) for r in df.collect()), key=str)
    want = rows(D.remove_spans(docs, _benchmark(spark)))
    live, most = set(), []

    class Held:
        def __init__(self, value):
            self.real = real(value)
            live.add(self)
            most.append(len(live))

        def destroy(self):
            live.discard(self)
            self.real.destroy()

        @property
        def value(self):
            return self.real.value

        def __reduce__(self):
            return (lambda x: x, (self.real,))

    real = spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", Held)
    assert D.block_count(_benchmark(spark), 4) > 3
    out = D.remove_spans(docs, _benchmark(spark), block_words=4)
    assert rows(out) == want and out.columns == docs.columns
    assert max(most) == 1 and not live
    assert H.pairs(D.remove_spans(docs, _benchmark(spark).limit(0), block_words=4)) == H.pairs(docs)


def test_empty_benchmark_and_empty_documents(spark):
    none = _benchmark(spark).limit(0)
    rows = D.report(D.find(H.awkward(spark), none)).collect()
    assert len(rows) == len(H.TEXTS) and not any(r.contaminated for r in rows)
    assert D.find(H.awkward(spark).limit(0), _benchmark(spark)).count() == 0
    assert H.pairs(D.remove_spans(H.awkward(spark), none)) == H.pairs(H.awkward(spark))


def _scan(*texts):
    return list(L.Scanner().scan(pa.array(texts, pa.string())))


def test_base_places_in_any_case_and_with_any_separators():
    (n, base, _, _), (_, none, extra, covered) = _scan("The GNU  General-Public\nLICENSE; cc by, CC-BY. Apache license", "gnu general license cc bye")
    assert n == 11 and base == [(1, "gpl"), (5, "cc-by"), (7, "cc-by"), (9, "apache")]
    assert none == [] and extra == set() and covered == 0


def test_templates_accept_optional_and_replaceable_regions():
    got = [extra for _, _, extra, _ in _scan(
        "Released under the MIT License.", "under the terms of the MIT license", "released beneath the MIT license",
        "Licensed under the Apache License, Version 2.0", "licensed under the apache license version 3 0",
        "This tiny little work is licensed under the GNU General Public License", "This a b c d is licensed under the GNU General Public License, version 3",
        "Copyright (c) 2001 Ann Example. All rights reserved", "copyright all rights reserved", "CC BY-SA 4.0")]
    assert got == [{"mit-notice"}, {"mit-notice"}, set(), {"apache-2.0-notice"}, set(), {"gpl-work", "gpl-notice"}, {"gpl-notice"},
                   {"all-rights-reserved"}, set(), {"cc-by-notice"}]


def test_an_automaton_reports_the_longest_stretch():
    auto = L.compile_template("t", "a [[b [[c]]]] d {{x:2}} e")
    run = lambda text: auto.run([L._hash(w) for w in text.split()], 0)
    assert [run(t) for t in ("a d x e", "a b d x y e", "a b c d x e e", "a c d x e", "a d e", "a d x y z e")] == [4, 6, 7, -1, -1, -1]
    with pytest.raises(ValueError):
        L.Scanner(templates=[("bad", "{{any:2}} license")])


def test_license_rows_equal_brute_force(spark):
    docs = H.small_documents(spark)
    texts = H.TEXTS + [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(str((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)) for r in L.scan(H.awkward(spark, texts)).collect())
    want = []
    for i, t in texts:
        w = H.ALNUM.findall(H.low(t))
        at = sorted((s, label) for phrase, label in L.BASE.items() for p in [phrase.split()]
                    for s in range(len(w) - len(p) + 1) if w[s:s + len(p)] == p)
        want.append(str((i, len(w), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at})))))
    assert got == sorted(want)
    rows = L.scan(H.awkward(spark)).collect()
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in rows)
    assert L.scan(H.awkward(spark).limit(0)).count() == 0

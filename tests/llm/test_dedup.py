"""Exact, near and substring deduplication."""

import hashlib
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from metroscope.llm import exact_dedup, near_dedup, runtime, substring_dedup


def _index(spark):
    return exact_dedup.DigestIndex(spark, runtime.scratch(spark, "t-index"), 4)


def test_exact_decisions_on_awkward_rows(spark):
    got = exact_dedup.decisions(H.awkward(spark), _index(spark)).collect()
    groups = defaultdict(list)
    for i, t in H.TEXTS:
        groups[hashlib.sha256(H.low(t).encode()).hexdigest()].append(i)
    assert len(got) == len(H.TEXTS)
    for r in got:
        ids = groups[r.text_sha256]
        keep = max((i for i in ids if i is not None), default=None)
        assert (r.keep_id, r.group_size, r.kept) == (keep, len(ids), r.doc_id == keep)


def test_exact_filter_keeps_one_row_of_each_text_and_all_columns(spark):
    docs = H.awkward(spark)
    kept = exact_dedup.deduplicate(docs, _index(spark))
    assert kept.columns == docs.columns
    texts = [H.low(r.text) for r in kept.collect()]
    assert sorted(texts) == sorted({H.low(t) for _, t in H.TEXTS})


def test_exact_filter_moves_and_hashes_whole_rows_once(spark):
    docs = runtime.stored(H.awkward(spark, [(1, "One ü"), (1, "one ü"), (2, "ONE ü"), (2, "one ü"), (None, "two"), (None, "Two"), (None, None), (3, "")]), "t-docs")
    kept = exact_dedup.deduplicate(docs, _index(spark))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("+- Sort [") + plan.count(":- Sort [") == 2  # rows and kept keys
    assert plan.count("sha2(") == 1
    assert sorted((r.doc_id or 0, H.low(r.text)) for r in kept.collect()) == [(0, "two"), (2, "one ü"), (3, "")]


def test_exact_index_persists_between_batches(spark):
    path = runtime.scratch(spark, "t-index")
    first = exact_dedup.DigestIndex(spark, path, 4)
    a = H.awkward(spark, [(1, "One"), (2, "two")])
    assert sorted(r.doc_id for r in exact_dedup.deduplicate(a, first).collect()) == [1, 2]
    again = exact_dedup.DigestIndex(spark, path, 4)
    b = H.awkward(spark, [(3, "ONE"), (4, "three"), (5, "three")])
    assert [r.doc_id for r in exact_dedup.deduplicate(b, again).collect()] == [5]
    assert again.bucketed().count() == 3
    plan = again.bucketed().join(again.bucketed().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan  # bucketed and sorted by digest: no shuffle


def test_substring_dedup_equals_brute_force(spark):
    for texts in (H.TEXTS, [(r.doc_id, r.text) for r in H.small_documents(spark).collect()]):
        got = sorted(map(str, (tuple(r) for r in substring_dedup.remove_repeats(H.awkward(spark, texts)).collect())))
        assert got == sorted(map(str, H.substring_dedup(texts)))


def test_a_full_sketch_loses_no_window(spark):
    texts = [(i, f"head{i} " + H.PASSAGE + f" tail{i}") for i in range(30)]
    got = sorted(tuple(r) for r in substring_dedup.remove_repeats(H.awkward(spark, texts), max_sketch=16).collect())
    assert got == H.substring_dedup(texts)


def test_near_classes_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    base = [f"term{i}" for i in range(120)]
    texts = list(H.TEXTS)
    for c in range(40):  # a family of edited copies, and copies of copies that drift
        w = list(base)
        for j in rng.choice(120, 1 + c % 4, replace=False):
            w[j] = f"edit{c}x{j}"
        texts.append((100 + c, " ".join(w)))
        if c % 3 == 0:
            base = w
    texts += [(200, "only four words here"), (201, "Only FOUR words, here!"), (202, "line again and again " * 30)]
    want = H.near_classes(texts)
    got = near_dedup.groups(H.awkward(spark, texts)).collect()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.class_id, r.class_size))
    assert len(got) == len(texts)
    members = defaultdict(list)
    for n, root in enumerate(want):
        members[root].append(texts[n][0])
    for n, (i, t) in enumerate(texts):
        ids = members[want[n]]
        if not H.ALNUM.findall(H.low(t)):
            assert (i, 1) in by_id[i]
        else:
            assert (min((x for x in ids if x is not None), default=None), len(ids)) in by_id[i]


def test_a_pair_just_below_the_bound_hides_no_link_of_its_classes(spark):
    bag = lambda lo, hi: (np.arange(lo, hi, dtype=np.uint64) << np.uint64(40)).tobytes()
    own = {b"a1": bag(0, 900), b"b1": bag(101, 1000), b"a2": bag(2000, 2925), b"b2": bag(2075, 3000)}  # 0.799 and 0.85
    one = np.ones(1000)
    assert near_dedup.similarity(*((np.frombuffer(own[k], np.uint64), one[:len(own[k]) // 8]) for k in (b"a1", b"b1"))) == pytest.approx(0.799)
    members = spark.createDataFrame([(7, k, k[:1], k[:1] == b"b", 1, 1) for k in own],
                                    "band long, node binary, root binary, guest boolean, hosts int, guests int")
    nodes = spark.createDataFrame([(k, [7, *range(100 * i, 100 * i + 19)]) for i, k in enumerate(own, 1)], "node binary, bands array<long>")
    shingles = spark.createDataFrame([(k, v, None) for k, v in own.items()], "node binary, shingle binary, weight binary")
    links = near_dedup.verified(near_dedup.crossing(members, nodes, shingles), shingles).collect()
    assert [(bytes(r.a), bytes(r.b)) for r in links] == [(b"b2", b"a2")]


def test_a_similarity_of_exactly_the_bound_links(spark):
    for union in range(5, 2000, 5):
        common = union * 4 // 5
        a, b = np.arange(common, dtype=np.uint64), np.arange(union, dtype=np.uint64)
        for weight in (1.0, 1 + np.log(2)):
            assert near_dedup.linked((a, np.ones(len(a))), (b, np.full(len(b), weight)))
        assert not near_dedup.linked((a[1:], np.ones(len(a) - 1)), (b, np.ones(len(b))))
    texts = []
    for i, n in enumerate((90, 54, 72, 117)):  # two words replaced: n - 10 common shingles of n + 10
        w = [f"t{i}x{j}" for j in range(n + 4)]
        texts += [(2 * i, " ".join(w)), (2 * i + 1, " ".join([*w[:20], "new", *w[21:40], "other", *w[41:]]))]
    want = H.near_classes(texts)
    assert want[0] == want[1] and want[2] != want[3]
    got = {r.doc_id: r.class_id for r in near_dedup.groups(H.awkward(spark, texts)).collect()}
    assert got == dict(enumerate(want))


def test_near_filter_keeps_one_of_each_class_and_wordless_rows(spark):
    docs = H.awkward(spark)
    kept = near_dedup.deduplicate(docs)
    assert kept.columns == docs.columns
    assert [(i, (t or "")[:20]) for i, t in H.pairs(kept)] == sorted(
        [(i, (t or "")[:20]) for i, t in H.TEXTS if i not in (5, 8, 9, 12)] + [(9, H.TEXTS[8][1][:20])],
        key=lambda p: (p[0] is not None, p[0], p[1]))


def test_any_column_name_passes_through(spark):
    from metroscope.llm import decontaminate
    item = spark.createDataFrame([(1, "beta gamma")], "item_id long, text string")
    docs = H.awkward(spark, [(1, "alpha beta gamma delta"), (2, "ALPHA beta gamma delta"), (3, "")]).withColumnsRenamed(
        {"lang": "a.b", "source": "x`y", "row": "two words"})
    for out, ids in ((exact_dedup.deduplicate(docs, _index(spark)), [2, 3]), (near_dedup.deduplicate(docs), None),
                     (decontaminate.remove_spans(docs, item), [1, 2, 3]), (decontaminate.remove_spans(docs, item, block_words=1), [1, 2, 3])):
        assert out.columns == docs.columns and out.schema.names[2:4] == ["a.b", "x`y"]
        got = out.collect()
        assert ids is None or sorted(r.doc_id for r in got) == ids
        assert all(r["a.b"] == "en" and r["x`y"] == "s" for r in got)


def test_signature_agreement_estimates_probability_jaccard():
    import pyarrow as pa
    from metroscope.llm import words as W
    a = " ".join(f"w{i}" for i in range(400))
    b = " ".join(f"w{i}" if i % 40 else f"v{i}" for i in range(400)) + " w1 w2 w3 w4 w5" * 8
    w = W.split(pa.array([a, b]), "alnum")
    text, shingle, weight = near_dedup.shingles(w, w.hashes())
    cut = np.searchsorted(text, 1)
    exact = near_dedup.similarity((shingle[:cut], weight[:cut]), (shingle[cut:], weight[cut:]))
    assert exact == pytest.approx(H.probability_jaccard(H.weighted_shingles(a), H.weighted_shingles(b)), abs=1e-9)
    sig = near_dedup.signatures(text, shingle, weight, 2, parts=4000)
    assert (sig[0] == sig[1]).mean() == pytest.approx(exact, abs=0.035)


def test_empty_tables(spark):
    empty = H.awkward(spark).limit(0)
    assert exact_dedup.decisions(empty, _index(spark)).count() == 0
    assert exact_dedup.deduplicate(empty, _index(spark)).count() == 0
    assert near_dedup.groups(empty).count() == 0 and near_dedup.deduplicate(empty).count() == 0
    assert substring_dedup.remove_repeats(empty).count() == 0

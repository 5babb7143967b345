"""Quality, toxicity and language-model scores."""

import math
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from metroscope.llm import lm_bloom, quality, supervision, toxicity
from metroscope.llm.words import split

MID = "/root/testdata/sf0.01"


def _held_out(spark, scored, label, modulus, held):
    labels = {r[0]: r[1] for r in spark.read.parquet(f"{MID}/labels.parquet").select("doc_id", label).collect()}
    rows = scored.collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % modulus == held) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    return np.array([labels[r.doc_id] for r in own]), np.array([r.predicted for r in own])


def test_quality_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    y, p = _held_out(spark, quality.score(docs, quality.train(docs, spark.read.parquet(f"{MID}/labels.parquet"))), "quality", 4, 2)
    assert (y == p).mean() >= 0.97


def test_toxicity_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{MID}/documents.parquet")
    y, p = _held_out(spark, toxicity.score(docs, toxicity.train(docs, spark.read.parquet(f"{MID}/labels.parquet"))), "toxic", 3, 1)
    assert p[y == 0].mean() <= 0.02 and p[y == 1].mean() >= 0.7


def test_held_out_labels_teach_nothing(spark):
    docs = H.awkward(spark, [(i, f"text number {i}") for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2, None if i == 3 else 1) for i in range(40)] + [(None, 1, 1), (5, 1, 1)],
                                   "doc_id long, quality int, toxic int")
    rows = supervision.training_rows(docs, labels, "toxic", 3, 1).collect()
    assert {r.doc_id for r in rows} == {i for i in range(40) if zlib.crc32(str(i).encode()) % 3 != 1} - {3}
    assert supervision.training_rows(docs, labels, "quality", 4, 2, sample=5).count() == 5


@pytest.mark.parametrize("rows", [[], [(1, 1, 1), (4, 1, 1)]])
def test_scores_of_awkward_rows_without_or_with_one_class(spark, rows):
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    docs = H.awkward(spark)
    for m in (quality, toxicity):
        got = m.score(docs, m.train(docs, labels)).collect()
        assert len(got) == len(H.TEXTS) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got}) == 1 and (rows or got[0].score == 0.5)
    kept = quality.accept(docs, quality.train(docs, labels), at_least=0.4)
    assert kept.columns == docs.columns and H.pairs(kept) == H.pairs(docs)
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == 0


def test_trees_learn_a_threshold_and_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 5)).astype(np.float32)
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > -0.2)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.97


def test_label_model_outvotes_a_noisy_voter_and_counts_tied_ones_once():
    rng = np.random.default_rng(6)
    y = rng.random(4000) < 0.3
    good = [np.where(rng.random(4000) < 0.9, y, ~y) for _ in range(3)]
    noise = rng.random(4000) < 0.5
    votes = np.column_stack([*good, noise, noise, noise, noise])  # one voter four times
    post, ties = toxicity.label_model(votes, 0.3, votes[:, 0] * 0.8 + 0.1, np.ones(4000))
    assert ((post > 0.5) == y).mean() > 0.96 and (ties[3:] == 4).all() and (ties[:3] == 1).all()


def test_patterns_see_an_insult_near_an_address():
    w = split(pa.array(["you are such an idiot", "the idiot plot", "", "nice words here", "you there far away from that very idiot"]), "alnum")
    assert toxicity.patterns(w)[:, :2].tolist() == [[True, True], [True, False], [False, False], [False, False], [True, False]]


def _base(texts):
    tokens = [H.SPACE.findall(H.low(t)) + [0] for _, t in texts]
    count = Counter()
    for (i, _), w in zip(texts, tokens):
        if i is None or zlib.crc32(str(i).encode()) % 7 != 2:
            count.update(w)
    n, v = sum(count.values()), len(count)
    return [(i, len(w), sum(count[x] > 0 for x in w), n, sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w))
            for (i, _), w in zip(texts, tokens)]


def _key(r):
    return (r[0] is not None, r[0] or 0, r[1], r[4])


def test_language_model_base_is_exact_and_the_model_beats_it_on_held_out_text(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{MID}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.held_out)
                  for r in lm_bloom.score(spark.read.parquet(f"{MID}/documents.parquet")).collect()), key=_key)
    for g, w in zip(got, sorted(_base(texts), key=_key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9) and g[5] <= 0
    held = [g for g in got if g[6]]
    assert sum(g[5] for g in held) > sum(g[4] for g in held)


def test_language_model_on_awkward_and_empty_tables(spark):
    got = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in lm_bloom.score(H.awkward(spark)).collect()), key=_key)
    for g, w in zip(got, sorted(_base(H.TEXTS), key=_key), strict=True):
        assert g[:4] == w[:4] and g[4] == pytest.approx(w[4], rel=1e-9)
    assert lm_bloom.score(H.awkward(spark).limit(0)).count() == 0
    held_only = [(i, "a b c") for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2]
    rows = lm_bloom.score(H.awkward(spark, held_only)).collect()
    assert len(rows) == len(held_only) and all(r.train_tokens == 0 and r.base_score == 0 and math.isfinite(r.score) for r in rows)


def test_filter_never_forgets_and_rarely_invents():
    rng = np.random.default_rng(8)
    h = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    counts = rng.integers(1, 400, 20_000)
    data, bits = lm_bloom.build_segment([(h, counts, 1)])
    f = lm_bloom.Filter(data, np.zeros(1, np.int64), np.array([bits], np.uint64), 0, 1)
    got = f.counts(h, 1)
    assert (got >= lm_bloom._VALUES[lm_bloom.level_of(counts)]).all()  # levels are never lost
    assert (got <= counts * lm_bloom.BASE + 1).mean() > 0.95
    strangers = rng.integers(0, 1 << 63, 20_000).astype(np.uint64)
    assert (f.counts(strangers, 1) > 0).mean() < 0.02


def test_the_filter_holds_every_ngram_however_many_slices_share_it(spark, monkeypatch):
    texts = [(i, "red green " * 500 + f"only{i} here{i}") for i in range(8) if zlib.crc32(str(i).encode()) % 7 != 2]
    want = {r.doc_id: r.score for r in lm_bloom.score(H.awkward(spark, texts)).collect()}
    monkeypatch.setattr(lm_bloom, "parts_for", lambda *_: 1 << 22)  # a 48 MB filter would leave each of them 96 bits
    model = lm_bloom.Model(lm_bloom.chunk_table(H.awkward(spark, texts), "t-chunks", lm_bloom.CHUNK_BYTES))
    got = {r.doc_id: r.score for r in model.score().collect()}
    assert got == {i: pytest.approx(s, rel=0.02) for i, s in want.items()}
    words, pairs, triples = Counter(), Counter(), Counter()
    for _, t in texts:
        w = t.split() + ["</s>"]
        words.update(w)
        pairs.update(zip(["<s>", *w], w))
        triples.update(zip(["<s>", "<s>", *w], ["<s>", *w], w))
    levels = lm_bloom.level_of(np.array([*words.values(), *pairs.values(), *triples.values()]))
    assert model.bits == np.maximum(64, levels * lm_bloom.BITS_PER_ITEM).sum()  # one n-gram a slice


def _by_hand(model, texts):
    """Scores token by token in plain Python, reading counts from the model's own stored filter."""
    held = lm_bloom.Segments.of(model.segments.collect(), 0, model.slices, model.slices)
    k, m, a = model.weights

    def count(order, h):
        return float(held.filter.counts(np.array([h], np.uint64), order)[0])
    out = {}
    for i, text in texts:
        t = lm_bloom.tokens(pa.array([text]))
        c = [[count(order, h) for h in hashes] for order, hashes in ((1, t.hash), (2, t.pair), (3, t.triple))]
        total, ends = 0.0, c[0][-1]
        pairs = [min(x, y, z) for x, y, z in zip(c[1], c[0], [ends, *c[0]])]
        for j, (w, vw, uvw) in enumerate(zip(c[0], pairs, c[2])):
            v, uv = (c[0][j - 1], pairs[j - 1]) if j else (ends, ends)
            p = min((w + a) / (model.total + a * (model.distinct + 1)), 1)
            p = m * vw / v + (1 - m) * p if v else p
            p = k * min(uvw, vw, uv) / uv + (1 - k) * p if uv else p
            total += math.log10(p)
        out[i] = total
    return out


def _prose(n, seed=3):
    rng = np.random.default_rng(seed)
    words = [f"w{j}" for j in range(40)]
    return [(i, " ".join(words[int(x)] for x in np.minimum(rng.geometric(0.12, rng.integers(0, 60)), 39))) for i in range(n)]


def test_scores_equal_a_model_by_hand_in_one_pass_and_in_several(spark, monkeypatch):
    monkeypatch.setattr(lm_bloom, "parts_for", lambda *_: 16)
    texts = _prose(80)
    chunks = lm_bloom.chunk_table(H.awkward(spark, texts).repartition(3), "t-chunks", 2000)
    one, many = lm_bloom.Model(chunks), lm_bloom.Model(chunks, pass_bytes=1500)
    assert one.passes == 1 and many.passes >= 3 and one.weights == many.weights
    want = _by_hand(one, texts)
    key = lambda rows: sorted(tuple(r) for r in rows)
    assert key(one.score().collect()) == key(many.score().collect())
    assert {r.doc_id: r.score for r in one.score().collect()} == {i: pytest.approx(v, rel=1e-9) for i, v in want.items()}
    others = [(i, f"w1 w2 w{i} never seen here") for i in range(30)]  # texts that were not counted
    for model in (one, many):
        got = {r.doc_id: r.score for r in model.score(H.awkward(spark, others)).collect()}
        assert got == {i: pytest.approx(v, rel=1e-9) for i, v in _by_hand(one, others).items()}


def test_a_task_sends_one_message_for_each_slice():
    """However many chunks a task holds, and however often a slice's n-grams occur in them."""
    sent = []
    real = lm_bloom._messages
    for chunks in (1, 2, 4):
        held = []
        for i in range(chunks):
            t = lm_bloom.tokens(pa.array([x for _, x in _prose(50, i)]))
            held.append([np.unique(h, return_counts=True) for h in (t.hash, t.pair, t.triple)])
        sent.append(real(lm_bloom._added(held), 8).num_rows)
    assert sent == [8, 8, 8]


def test_a_repeated_labelled_row_does_not_exceed_the_sample(spark):
    docs = H.awkward(spark, [(6, f"copy {i}") for i in range(3000)] + [(i, f"text {i}") for i in range(40)])
    labels = spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")
    rows = supervision.training_rows(docs, labels, "quality", 4, 2, sample=5).collect()
    assert len(rows) == 5
    rows = supervision.training_rows(docs, labels, "quality", 4, 2).collect()
    assert len(rows) == len({r.doc_id for r in rows}) and 6 in {r.doc_id for r in rows}

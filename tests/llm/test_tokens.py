"""Token ids, packing and the token-id store against the tokenizer itself."""

import sys
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from metroscope.llm import packing, runtime, token_store
from metroscope.llm.queries import tokenizer_path
from metroscope.llm.tokens import Encoder


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    return t


def _ids(tokenizer, text, end):
    return np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [end], "<u4")


ENCODER = Encoder(tokenizer_path())


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé1 \n\t.,'s|#  　数ß×\x85\x1c"), max_size=30), min_size=1, max_size=4))
def test_ids_are_the_tokenizers(tokenizer, texts):
    ids, off = ENCODER.encode(pa.array(texts, pa.string()), 7)
    for i, t in enumerate(texts):
        assert ids[off[i]:off[i + 1]].tolist() == _ids(tokenizer, t, 7).tolist()


def test_store_round_trip_and_single_documents(spark, tokenizer):
    path = runtime.scratch(spark, "t-store")
    token_store.write(H.awkward(spark), path, tokenizer_path())
    store = token_store.Store(spark, path)
    got = store.documents(with_ids=True).collect()
    order = sorted(H.TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    assert len(got) == len(order)
    want = sorted((i is not None, i or 0, _ids(tokenizer, t, 2).tobytes()) for i, t in order)
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):  # ascending ids, gapless
        assert r.start == at and r.n_tokens * 4 == len(r.ids) and r.ids_crc32 == zlib.crc32(bytes(r.ids))
        at += r.n_tokens
    ids = [r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert [x.tolist() for x in store.document(4)] == [_ids(tokenizer, "Alpha beta GAMMA delta", 2).tolist()]
    assert len(store.document(9)) == 2 and store.document(999) == []


def test_the_smallest_id_is_not_a_null_and_wide_ids_are_refused(spark):
    least = -(1 << 63)
    path = runtime.scratch(spark, "t-store")
    token_store.write(H.awkward(spark, [(least, "a b c"), (None, "d e"), (5, "f")]), path, tokenizer_path())
    store = token_store.Store(spark, path)
    assert sorted((str(r.doc_id), r.n_tokens) for r in store.documents().collect()) == sorted(
        (str(i), n) for i, n in ((least, 4), (None, 3), (5, 2)))
    assert [len(x) for x in store.document(least)] == [4]
    with pytest.raises(Exception, match="does not fit"):
        token_store.write(H.awkward(spark, [(1, "a b c")]), runtime.scratch(spark, "t-store"), tokenizer_path(), end_id=70_000)


def test_a_foreign_dictionary_is_refused(spark):
    path = runtime.scratch(spark, "t-store")
    token_store.write(H.awkward(spark, [(1, "a b c"), (2, "d e f")]), path, tokenizer_path())
    store = token_store.Store(spark, path)
    store.dictionary = b"something else entirely"
    with pytest.raises(Exception, match="another dictionary"):
        store.documents().collect()


def test_packing_covers_every_id_once_without_padding(spark, tokenizer):
    docs = H.awkward(spark).unionByName(H.awkward(spark, [(1000 + r.doc_id, r.text) for r in H.small_documents(spark).collect()]))
    pieces = packing.pack(docs, tokenizer_path(), with_ids=True).collect()
    by_row = defaultdict(list)
    for p in pieces:
        assert zlib.crc32(bytes(p.ids)) == p.ids_crc32 and len(p.ids) == 4 * p.length
        by_row[p.doc_id].append(p)
    for i, t in [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect() if r.doc_id not in (9, None)]:
        own = sorted(by_row[i], key=lambda p: p.start)
        assert b"".join(bytes(p.ids) for p in own) == _ids(tokenizer, t, 1).tobytes()
        assert {p.doc_tokens for p in own} == {sum(p.length for p in own)}
    sequences, steps = defaultdict(list), defaultdict(int)
    for p in pieces:
        sequences[p.sequence_id].append(p)
        steps[p.step_id] += p.length
    for own in sequences.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0, *(p.length for p in own)])[:-1].tolist()
        total = sum(p.length for p in own)
        assert total == own[0].tier and total & (total - 1) == 0 and total <= 2048
    assert max(steps.values()) <= packing.STEP_TOKENS


def test_tiers_fill_gaps_and_balance_steps():
    rng = np.random.default_rng(2)
    done, lengths = [], rng.integers(1, 5000, 3000)
    p = packing.Packer(lambda size, pieces: done.append((size, pieces)), waiting=32)
    for i, n in enumerate(lengths):
        p.add(i, np.zeros(n, np.uint32))
    p.close()
    assert sum(x.length for _, w in done for x in w) == lengths.sum()
    assert all(sum(x.length for x in w) == size for size, w in done)
    assert len({size for size, _ in done}) >= 4 and sum(len(w) for _, w in done) < 1.4 * (len(lengths) + len(done))
    group = [w for size, w in done if size == 2048][:128]
    cost = [sum(x.length ** 2 for w in s for x in w) for s in packing._steps(group, 2048)]
    assert len(cost) == 4 and max(cost) < 1.05 * min(cost)


def test_empty_table(spark):
    empty = H.awkward(spark).limit(0)
    assert packing.pack(empty, tokenizer_path()).count() == 0
    path = runtime.scratch(spark, "t-store")
    token_store.write(empty, path, tokenizer_path())
    assert token_store.Store(spark, path).documents().count() == 0


def test_added_tokens_are_the_unaltered_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer
    from metroscope.llm import queries
    plain = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "none", "", "<|endoftext|><|endoftext|>", "x  <|endoftext|>", "<|endoftext|>'s <|endoftext", "|>"]
    ids, off = Encoder(tokenizer_path(), added=True).encode(pa.array(texts, pa.string()), 7)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [_ids(plain, t, 7).tolist() for t in texts]
    H.awkward(spark, list(enumerate(texts))).write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: zlib.crc32(_ids(plain, t, 2).tobytes()) for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids_crc32 for r in queries.op7(spark, str(tmp_path)).collect()} == want
    assert {r.doc_id: r.doc_tokens for r in queries.op2(spark, str(tmp_path)).collect()} == {i: len(_ids(plain, t, 1)) for i, t in enumerate(texts)}

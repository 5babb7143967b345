"""Line dedup: the minimal perfect hash, and the operator against a plain-Python twin."""

import re
import sys
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from metroscope.llm import line_dedup as L

EDGE = re.compile(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$")
SHARED = "This line of fifty characters stands in many texts."
WIDE = "数" * 40
DOCS = ([(i, f"own line number {i} that is long enough to be a key of its own\n  {SHARED.upper() if i % 2 else SHARED}\t\r\n{SHARED}\nshort") for i in range(20, 28)]
        + [(i, WIDE) for i in range(30, 34)] + [(None, WIDE + "\x0b")] + [(40 + i, "é" * 39) for i in range(6)]
        + [(50, ""), (51, None), (52, "\n\n"), (53, "\x1c" + SHARED), (54, "x" * 9000), (55, "X" * 9000), (56, " " + "x" * 9000), (57, "x" * 9000), (57, "x" * 9000), (57, "y" * 9000)]
        + [(None, "rows without an id share this line of over forty characters")] * 6)


def brute(docs, min_chars=40, min_docs=5):
    def key(line):
        return H.low(EDGE.sub("", line))
    rank = lambda i: (i is not None, i or 0)
    where = defaultdict(list)
    for n, (i, t) in enumerate(docs):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= min_chars:
                where[k].append(i)
    out = []
    for i, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < min_docs or rank(i) == max(map(rank, where[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=lambda r: (rank(r[0]), r[1:]))


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in df.collect()), key=lambda r: ((r[0] is not None, r[0] or 0), r[1:]))


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    rng = np.random.default_rng(n)
    h, f = rng.integers(0, 1 << 63, n, dtype=np.uint64), rng.integers(0, 1 << 63, n, dtype=np.uint64)
    h[: n // 3] = 7  # equal first hashes are told apart by the second
    sizes, bits = L.build_hash(h, f)
    assert sorted(L.PerfectHash(sizes, bits).slots(h, f).tolist()) == list(range(n))
    assert len(bits) * 8 <= 5 * n + 64 * 40


@pytest.mark.parametrize("docs", [DOCS, H.TEXTS * 5, []])
def test_lines_equal_brute_force(spark, docs):
    table = H.awkward(spark, docs).repartition(3)
    index = L.LineIndex(table)
    assert found(L.drop_lines(table, index)) == brute(docs)
    # a stored index answers higher thresholds too
    assert found(L.drop_lines(table, index, min_docs=7)) == brute(docs, min_docs=7)


def test_an_index_beyond_one_broadcast_gives_the_same_rows(spark):
    docs = [(i, "\n".join(f"line {j} of a family of lines that {'repeat' * (1 + j % 3)} often" for j in range(i % 7, 120, 1 + i % 5))) for i in range(60)] + DOCS
    table = H.awkward(spark, docs).repartition(4)
    index = L.LineIndex(table, shard_keys=10)
    assert index.shards >= 8 and len(index.groups(500)) >= 4
    want = brute(docs)
    assert found(L.drop_lines(table, index)) == want
    assert found(L.drop_lines(table, index, most_bytes=500)) == want


def test_threshold_below_the_floor_is_refused(spark):
    table = H.awkward(spark, DOCS)
    with pytest.raises(ValueError):
        L.drop_lines(table, L.LineIndex(table), min_docs=4)

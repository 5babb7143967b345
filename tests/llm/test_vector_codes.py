"""Vector codes: the dual-tree walk against all distances, and the operator against a plain-Python twin."""

import hashlib
import sys
from collections import defaultdict
from math import floor, inf, isfinite, nan
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers as H  # noqa: E402

from metroscope.llm import vector_codes as V


@pytest.mark.parametrize(("n", "entries", "span", "width"), [(1, 1, 5, 4), (7, 3, 3, 4), (100, 64, 4, 2), (3000, 64, 100, 4), (500, 5, 2, 1), (777, 33, 1, 3), (200, 64, 1 << 20, 4)])
def test_walk_equals_all_distances(n, entries, span, width):
    rng = np.random.default_rng(n)
    values = rng.integers(-span, span, (n, 3 * width))
    values[::3] = values[0]  # many equal vectors
    points, books = V._parts(values, 3), V._parts(rng.integers(-span, span, (entries, 3 * width)), 3)
    books[:, entries // 2] = books[:, 0]  # equal entries: the lower index wins
    depth = V.depth_for(n, V.LEAF)
    order = V.tree_order(points, depth)
    tree = V.Tree(np.take_along_axis(points, order[:, :, None], 1), depth)
    got = V.assign(tree, order, books, codes=True)
    want = ((points[:, :, None] - books[:, None]) ** 2).sum(3).argmin(2)
    assert (got.codes == want).all()
    for p in range(3):
        sums = np.zeros((entries, width), np.int64)
        np.add.at(sums, want[p], points[p])
        assert (got.sums[p] == sums).all() and (got.counts[p] == np.bincount(want[p], minlength=entries)).all()
    if n == 3000:
        assert got.whole > 0.2 * 3 * n and got.compared < 0.5 * 3 * n * entries  # whole nodes and pruned pairs, not a scan


def test_leaves_in_several_portions(monkeypatch):
    monkeypatch.setattr(V, "PAIRS_AT_ONCE", 97)
    test_walk_equals_all_distances(500, 5, 2, 1)
    test_walk_equals_all_distances(100, 64, 4, 2)


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector, label)"""
    rows = [r for r in rows if r[1] and all(x is not None and isfinite(x) for x in r[1])]
    if not rows:
        return []
    sizes = defaultdict(int)
    for r in rows:
        sizes[len(r[1])] += 1
    most = max(sizes, key=lambda k: (sizes[k], k))
    rows = [(i, [floor(256 * x) for x in v], label, v) for i, v, label in rows if len(v) == most]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[3]))
    w = most // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for p in range(parts)] for _, v, _, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for c in cut:
                own[nearest(p, c[p])[1]].append(c[p])
            books[p] = [tuple(sum(xs) // len(xs) for xs in zip(*own[k])) if own[k] else e for k, e in enumerate(books[p])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    coded = [[nearest(p, c[p]) for p in range(parts)] for c in cut]
    total = defaultdict(int)
    for r, c in zip(rows, coded):
        total[r[2]] += sum(d for d, _ in c)
    return sorted(((r[0], "".join(f"{k:02x}" for _, k in c), sum(d for d, _ in c), total[r[2]], sha) for r, c in zip(rows, coded)), key=lambda r: (r[0] is None, *[r[0] or 0, *r[1:]]))


def found(spark, rows, **how):
    table = spark.createDataFrame([(i, v, label, "x", 1) for i, v, label in rows], "vec_id long, embedding array<float>, label int, code string, part int").repartition(3)
    df = V.report(V.VectorCodes(table, **how))
    assert df.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, *[r[0] or 0, *r[1:]]))


def vectors(n, d, seed=3):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.2, d)], int(i) % 4 or None) for i in rng.permutation(n)]
    return rows + [(5, rows[0][1], 9)] * 20  # one vector many times, under one id


ODD = [(None, [0.5] * 32, 1), (900, None, 1), (901, [nan] + [0.0] * 31, 1), (902, [inf] * 32, 2), (903, [-inf] * 32, None), (904, [None] * 32, 2), (905, [], 3), (906, [1.0] * 16, 3),
       (-7, [-0.001] * 32, 1)]


@pytest.mark.parametrize("rows", [vectors(150, 32) + ODD, vectors(12, 16), ODD, ODD[1:6], []])
def test_codes_equal_brute_force(spark, rows):
    assert found(spark, rows) == brute(rows)


def test_more_rounds_and_other_sizes(spark):
    rows = vectors(90, 12, 8)
    assert found(spark, rows, parts=4, entries=10, rounds=5) == brute(rows, 4, 10, 5)


def test_blocks_do_not_matter(spark, monkeypatch):
    rows = vectors(60, 16)
    monkeypatch.setattr(V, "BLOCK_ROWS", 9)
    assert found(spark, rows) == brute(rows)


def test_impossible_input_is_refused(spark):
    with pytest.raises(Exception, match="equal parts"):
        found(spark, [(1, [0.0] * 10, 1)])
    with pytest.raises(Exception, match="64-bit"):
        found(spark, [(1, [1e30] * 16, 1)])


def test_small_sample_of_the_given_table(spark):
    t = spark.read.parquet(f"{H.SMALL}/embeddings.parquet")
    rows = [(r.vec_id, [float(x) for x in r.embedding], r.label) for r in t.collect()]
    got = sorted(tuple(r) for r in V.report(V.VectorCodes(t)).collect())
    assert got == brute(rows)

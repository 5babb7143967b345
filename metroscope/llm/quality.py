"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts are computed block by block with NumPy.  The trees
are grown on at most ``sample`` labelled rows (supervision.SAMPLE): features
are binned at quantiles, each level's gradient histograms come from one
``bincount``, and every tree is a complete binary tree kept in flat arrays, so
a block of documents goes down all trees by index arithmetic.  Scoring is one
pass over the documents without a shuffle.

Defined cases: a null text is the empty text and gets a score like any other;
without labelled rows every score is 0.5, with one class only its smoothed
share; repeated rows are scored alike; other columns are ignored (score) or
passed through (accept); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.llm.runtime import blocks, doc_text, plain, raw_text, string_column
from metroscope.llm.supervision import remainder, training_rows
from metroscope.llm.words import _runs, hash_spans, split

MODULUS, HELD = 4, 2
ACCEPT = 0.7
TREES, DEPTH, BINS, RATE, L2, MIN_CHILD = 80, 4, 64, 0.15, 1.0, 5.0

_b = np.arange(256)
_CLASSES = {  # share of a text's bytes
    "upper": (_b >= 0x41) & (_b <= 0x5A), "lower": (_b >= 0x61) & (_b <= 0x7A), "digit": (_b >= 0x30) & (_b <= 0x39),
    "high": _b >= 0x80, "space": _b == 0x20, "line": _b == 0x0A,
    "stop": np.isin(_b, [ord(c) for c in ".,;:?'\"()-"]), "symbol": np.isin(_b, [ord(c) for c in "#$%&*|!@<>{}[]\\/~^_=+`"]),
}
FEATURES = ["bytes", "words", "word_len", "word_len_sd", "longest", *_CLASSES, "distinct", "top_word", "adjacent",
            "distinct_pairs", "shouted", "decorated", "titled", "ended", "lines", "distinct_lines", "line_words"]


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]


def _distinct(owner: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: number of distinct values, and occurrences of the most frequent one."""
    order = np.lexsort((h, owner))
    o, x = owner[order], h[order]
    new = np.ones(len(o), bool)
    new[1:] = (o[1:] != o[:-1]) | (x[1:] != x[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(o)))
    top = np.zeros(n)
    np.maximum.at(top, o[at], size)
    return np.bincount(o[at], minlength=n).astype(float), top


def statistics(texts: pa.StringArray) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(texts)
    raw, off = raw_text(texts)
    w = split(texts, "space")
    count, size = w.counts.astype(float), np.diff(off).astype(float)
    length = (w.end - w.start).astype(float)
    per_word, per_byte = np.maximum(count, 1), np.maximum(size, 1)
    owner, h = w.owner(), w.hashes()
    mean = _sums(length, w.first) / per_word
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    out = [np.log1p(size), np.log1p(count), mean, np.sqrt(np.maximum(_sums(length ** 2, w.first) / per_word - mean ** 2, 0)), longest]
    at = {}
    for name, lut in _CLASSES.items():
        total = np.concatenate([[0], np.cumsum(lut[raw], dtype=np.int32)])
        at[name] = total
        out.append((total[off[1:]] - total[off[:-1]]) / per_byte)
    distinct, top = _distinct(owner, h, n)
    same = np.zeros(len(w))
    same[1:] = (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])
    pair = h.copy()
    pair[1:] = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
    pairs, _ = _distinct(owner, pair, n)
    inside = lambda name: at[name][w.end] - at[name][w.start]
    letters = inside("upper") + inside("lower")
    shouted = (inside("upper") >= 2) & (inside("lower") == 0)
    decorated = inside("symbol") > 0
    first_upper = _CLASSES["upper"][raw[w.start]] if len(w) else np.zeros(0, bool)
    ended = _CLASSES["stop"][raw[w.end - 1]] if len(w) else np.zeros(0, bool)
    out += [distinct / per_word, top / per_word, _sums(same, w.first) / per_word, pairs / per_word]
    out += [_sums(x, w.first) / per_word for x in (shouted, decorated, first_upper & (letters > 0), ended)]
    start, end = _runs(raw != 0x0A, off)
    first = np.searchsorted(start, off)
    line_owner = np.repeat(np.arange(n), np.diff(first))
    lines = np.maximum(np.diff(first), 1)
    kinds, _ = _distinct(line_owner, hash_spans(raw, start, end), n)
    out += [np.log1p(np.diff(first)), kinds / lines, np.log1p(count / lines)]
    return np.column_stack(out).astype(np.float32)


@dataclass
class Trees:
    """Complete trees of one depth in flat arrays: inner nodes (tree, node) and leaves (tree, leaf)."""
    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = np.full(len(x), self.base)
        row = np.arange(len(x))
        depth = self.value.shape[1].bit_length() - 1 if len(self.value) else 0
        for feature, threshold, value in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[row, feature[node]] > threshold[node])
            raw += value[node - (2 ** depth - 1)]
        return 1 / (1 + np.exp(-raw))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> Trees:
    """Grow the trees on binned features with logistic loss."""
    n = len(y)
    share = (float(y.sum()) + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    empty = np.zeros((0, 2 ** depth - 1))
    if n == 0 or y.min() == y.max():
        return Trees(base if n else 0.0, empty.astype(int), empty, np.zeros((0, 2 ** depth)))
    f = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1]).astype(np.float32)) for j in range(f)]
    binned = np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    slot = binned + np.arange(f) * BINS
    raw = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        feature, threshold = np.zeros(2 ** depth - 1, int), np.full(2 ** depth - 1, np.inf)
        for level in range(depth):
            width, start = 2 ** level, 2 ** level - 1
            at = ((node - start)[:, None] * (f * BINS) + slot).ravel()
            hist = [np.bincount(at, np.repeat(v, f), width * f * BINS).reshape(width, f, BINS).cumsum(2) for v in (g, h)]
            (gl, hl), (gt, ht) = hist, (hist[0][:, :1, -1:], hist[1][:, :1, -1:])
            gain = gl ** 2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt ** 2 / (ht + L2)
            gain[(hl < MIN_CHILD / 4) | (ht - hl < MIN_CHILD / 4)] = 0
            for j, e in enumerate(edges):
                gain[:, j, len(e):] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), BINS)
                if gain[k, j, b] > 1e-6:
                    feature[start + k], threshold[start + k] = j, edges[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - (2 ** depth - 1)
        value = -RATE * np.bincount(leaf, g, 2 ** depth) / (np.bincount(leaf, h, 2 ** depth) + L2)
        raw += value[leaf]
        features.append(feature), thresholds.append(threshold), values.append(value)
    return Trees(base, np.array(features), np.array(thresholds), np.array(values))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = MODULUS, held: int = HELD, **limits) -> Trees:
    """Fit on a bounded sample of labelled rows outside the held-out remainder."""
    def features(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches, limit=1 << 20):  # eight sums over every byte: small blocks
            x = statistics(string_column(b, "text"))
            raw = [r.tobytes() for r in x]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(raw, pa.binary())], ["doc_id", "y", "x"])

    rows = training_rows(docs, labels, label, modulus, held, **limits).mapInArrow(features, "doc_id long, y int, x binary").collect()
    rows.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    x = np.array([np.frombuffer(r.x, np.float32) for r in rows]).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([r.y for r in rows], float))


def score(docs: DataFrame, model: Trees) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches, limit=1 << 20):  # eight sums over every byte: small blocks
            s = np.clip(model.score(statistics(string_column(b, "text"))), 0, 1)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return (doc_text(docs).mapInArrow(run, "doc_id long, score double")
            .select("doc_id", (remainder("doc_id", MODULUS) == HELD).alias("held_out"), "score",
                    (F.col("score") >= ACCEPT).cast("int").alias("predicted")))


def accept(docs: DataFrame, model: Trees, at_least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose text the model accepts, all columns unchanged."""
    names, docs = docs.columns, plain(docs)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches, limit=1 << 20):  # eight sums over every byte: small blocks
            s = model.score(statistics(string_column(b, "text")))
            yield b.filter(pa.array(s >= at_least))

    return docs.mapInArrow(run, docs.schema).toDF(*names)

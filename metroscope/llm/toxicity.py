"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

1. Voters.  Lexicon voters are words and word beginnings that stand out in the
   labelled training rows; pattern voters look at insults addressed to a
   reader and the like; one voter speaks for clean text when no lexicon voter
   fires; the given label is a voter too, whose accuracy is estimated like the
   others', so a wrong label can be outvoted.
2. Label model.  Expectation maximisation estimates for each voter how often
   it fires on toxic and on clean text.  Voters that still fire together given
   the posterior label are correlated: the evidence of each is divided by the
   number of voters it is tied to, so a block of tied voters counts once.
3. Classifier.  A logistic regression on word and word-beginning features is
   trained on the posterior labels; it alone scores texts.

All of it is fitted on at most ``sample`` labelled rows (SAMPLE); scoring is
one pass over all documents without a shuffle.

Defined cases: a null text is the empty text and gets a score like any other;
without labelled rows every score is 0.5, with one class only the smoothed
share; repeated rows are scored alike; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.llm.runtime import blocks, doc_text, string_column
from metroscope.llm.supervision import remainder, training_rows
from metroscope.llm.words import Words, hash_spans, mix, split

MODULUS, HELD = 3, 1
TOXIC = 0.7
BEGINNINGS = (4, 5, 6)     # bytes of a word's beginning that form features of their own
LEXICON = 400              # lexicon voters
FEATURES = 4000            # features of the classifier
MIN_DOCS = 3               # documents a lexicon entry or feature must occur in
ROUNDS = 240
SAMPLE = 6000            # labelled rows the model is fitted on, at most

# fixed values: general insults and forms of address, by language (en, de, fr, es)
INSULTS = ("idiot moron stupid dumb fool loser scum trash pathetic worthless disgusting jerk creep liar coward clown "
           "dummkopf blödmann arschloch depp trottel imbécile crétin salaud abruti connard tonto imbécil estúpido cabrón").split()
ADDRESS = "you your youre u du dein ihr tu toi ton vous eres tú usted".split()


def _hash_words(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    end = np.cumsum([len(r) for r in raw])
    return hash_spans(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], end[:-1]]), end)


def word_features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and of the beginnings of longer words."""
    owner, out, who = w.owner(), [w.hashes()], []
    who.append(owner)
    for k in BEGINNINGS:
        longer = w.end - w.start > k
        s = w.start[longer]
        out.append(mix(hash_spans(w.buf, s, s + k), 100 + k))
        who.append(owner[longer])
    return np.concatenate(who), np.concatenate(out)


def _distinct_pairs(who: np.ndarray, what: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((what, who))
    a, b = who[order], what[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def patterns(w: Words) -> np.ndarray:
    """One row of pattern votes per text: insult, insult near an address, several insults, dense insults."""
    n = len(w.first) - 1
    h, owner = w.hashes(), w.owner()
    insult, address = np.isin(h, _hash_words(INSULTS)), np.isin(h, _hash_words(ADDRESS))
    near = np.zeros(len(h), bool)
    for gap in range(1, 5):
        near[gap:] |= insult[gap:] & address[:-gap] & (owner[gap:] == owner[:-gap])
    count = np.bincount(owner, insult, n)
    words = np.maximum(w.counts, 1)
    return np.column_stack([count > 0, np.bincount(owner, near, n) > 0, count >= 3, count / words > 0.02])


@dataclass
class Model:
    """Sorted feature hashes, their weights and the intercept."""
    feature: np.ndarray
    weight: np.ndarray
    bias: float

    def score(self, w: Words) -> np.ndarray:
        n = len(w.first) - 1
        if not len(self.feature):
            return np.full(n, 1 / (1 + np.exp(-self.bias)))
        who, what = word_features(w)
        at = np.minimum(np.searchsorted(self.feature, what), len(self.feature) - 1)
        hit = self.feature[at] == what
        a, b = _distinct_pairs(who[hit], at[hit])
        z = self.bias + np.bincount(a, self.weight[b], n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def label_model(votes: np.ndarray, prior: float, start: np.ndarray, weight: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of label 1 for each row of boolean ``votes``, and each voter's tie count.

    ``start`` is the first guess of the posteriors, ``weight`` what each row
    counts.  Ties are the voters whose
    residual (vote minus its expectation given the posterior) correlates
    above one half.
    """
    post = start.astype(float)
    v = votes.astype(np.float32)
    ties = np.ones(votes.shape[1])
    for step in range(rounds):
        on1, on0 = weight * post, weight * (1 - post)
        p1, p0 = (on1 @ v + 0.5) / (on1.sum() + 1), (on0 @ v + 0.5) / (on0.sum() + 1)
        if step % 8 == 0:
            rest = v - (post[:, None] * p1 + (1 - post)[:, None] * p0).astype(np.float32)
            sd = np.sqrt((rest ** 2).mean(0)) + 1e-9
            ties = (np.abs(rest.T @ rest / len(v) / np.outer(sd, sd)) > 0.5).sum(1).clip(1)
        on, off = np.log(p1 / p0) / ties, np.log((1 - p1) / (1 - p0)) / ties
        new = _sigmoid(np.log(prior / (1 - prior)) + v @ (on - off) + off.sum())
        done = np.abs(new - post).max() < 1e-4
        post = new
        if done:
            break
    return post, ties


def copy_weights(rows: np.ndarray, features: np.ndarray, n: int, smallest: int = 4) -> np.ndarray:
    """1 over the number of rows with the same few smallest feature hashes: copies of a text count about once."""
    order = np.lexsort((features, rows))
    at = np.searchsorted(rows[order], np.arange(n + 1))
    key = np.zeros((n, smallest), np.uint64)
    for k in range(smallest):
        has = at[:-1] + k < at[1:]
        key[has, k] = features[order][at[:-1][has] + k]
    _, back, size = np.unique(key, axis=0, return_inverse=True, return_counts=True)
    return 1.0 / size[back.ravel()]


def _group(rows: np.ndarray, cols: np.ndarray, n: int, weight: np.ndarray) -> np.ndarray:
    return np.bincount(cols, weight[rows], n)


def fit(rows: np.ndarray, features: np.ndarray, votes: np.ndarray, y: np.ndarray) -> Model:
    """Model from distinct (row, feature) pairs, pattern votes and the labels that seed the voters."""
    n = len(y)
    share = (float(y.sum()) + 0.5) / (n + 1)
    none = np.zeros(0, np.uint64)
    if n == 0 or y.min() == y.max():
        return Model(none, np.zeros(0), float(np.log(share / (1 - share))) if n else 0.0)
    names, col = np.unique(features, return_inverse=True)
    weight = copy_weights(rows, features, n)
    docs = _group(rows, col, len(names), weight)
    keep = docs >= MIN_DOCS
    n_eff = weight.sum()

    def evidence(target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log odds ratio of each feature, and its likelihood-ratio statistic (0 below MIN_DOCS)."""
        a, t = _group(rows, col, len(names), target * weight), (target * weight).sum()
        odds = np.log((a + 0.5) / (t + 1)) - np.log((docs - a + 0.5) / (n_eff - t + 1))
        own = lambda k, total, p: k * np.log(np.maximum(k, 1e-12) / (total * p)) + (total - k) * np.log(np.maximum(total - k, 1e-12) / (total * (1 - p)))
        p = np.clip(docs / n_eff, 1e-9, 1 - 1e-9)
        return odds, np.where(keep, 2 * (own(a, t, p) + own(docs - a, n_eff - t, p)), 0)

    # lexicon voters: entries that toxic rows have far more often than chance among all features explains
    odds, worth = evidence(y)
    sure = 2 * np.log(max(2, int(keep.sum())))
    worth = np.where((odds > 1.5) & (worth > sure), worth, -np.inf)
    chosen = np.argsort(-worth, kind="stable")[:LEXICON]
    chosen = chosen[np.isfinite(worth[chosen])]
    where = np.full(len(names), -1)
    where[chosen] = np.arange(len(chosen))
    lexicon = np.zeros((n, len(chosen)), bool)
    hit = where[col] >= 0
    lexicon[rows[hit], where[col[hit]]] = True
    every = np.column_stack([lexicon, votes, ~lexicon.any(1), y > 0.5])
    every = every[:, every.any(0)]
    post, _ = label_model(every, share, np.clip(y, 0.02, 0.98), weight)
    # classifier on posterior labels
    _, worth = evidence(post)
    used = np.argsort(-worth, kind="stable")[:FEATURES]
    used = np.sort(used[worth[used] > sure])
    where = np.full(len(names), -1)
    where[used] = np.arange(len(used))
    hit = where[col] >= 0
    r, c = rows[hit], where[col[hit]]
    w, b = np.zeros(len(used)), float(np.log(share / (1 - share)))
    gw, gb = np.full(len(used), 1e-6), 1e-6
    for _ in range(ROUNDS):
        p = _sigmoid(b + np.bincount(r, w[c], n))
        err = weight * (p - post)
        dw, db = np.bincount(c, err[r], len(used)) / n_eff + 1e-5 * w, err.sum() / n_eff
        gw, gb = gw + dw ** 2, gb + db ** 2
        w, b = w - 0.5 * dw / np.sqrt(gw), b - 0.5 * db / np.sqrt(gb)
    return Model(names[used], w, float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = MODULUS, held: int = HELD, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` labelled rows outside the held-out remainder."""
    def features(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches):
            w = split(string_column(b, "text"), "alnum")
            who, what = _distinct_pairs(*word_features(w))
            first, votes = np.searchsorted(who, np.arange(len(w.first))), patterns(w)
            raw = [what[first[i]:first[i + 1]].tobytes() for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(raw, pa.binary()),
                                              pa.array([v.astype(np.uint8).tobytes() for v in votes], pa.binary())], ["doc_id", "y", "x", "votes"])

    found = training_rows(docs, labels, label, modulus, held, sample).mapInArrow(features, "doc_id long, y int, x binary, votes binary")
    rows = sorted(found.collect(), key=lambda r: (r.doc_id, bytes(r.x)))
    x = [np.frombuffer(r.x, np.uint64) for r in rows]
    y = np.array([r.y for r in rows], float)
    votes = np.array([np.frombuffer(r.votes, np.uint8) for r in rows]).reshape(len(rows), 4).astype(bool)
    at = np.repeat(np.arange(len(x)), [len(v) for v in x]) if x else np.zeros(0, np.int64)
    return fit(at, np.concatenate(x) if x else np.zeros(0, np.uint64), votes, y)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches):
            s = model.score(split(string_column(b, "text"), "alnum"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], ["doc_id", "score"])

    return (doc_text(docs).mapInArrow(run, "doc_id long, score double")
            .select("doc_id", (remainder("doc_id", MODULUS) == HELD).alias("held_out"), "score",
                    (F.col("score") >= TOXIC).cast("int").alias("predicted")))

"""Language-model scores from a log-frequency Bloom filter.

Training tokens are white-space words with A-Z lower-cased, and one end token
per text.  Words, pairs and triples of the whole training part are counted:
every task adds up its chunks and sends its distinct hashes with their counts
to hash slices, where they are added up.  A slice becomes a segment of the
model, which is stored: the exact counts of its words (they give the base
score) and a piece of the filter: an n-gram of count c is inserted
``1 + floor(log_B c)`` times, once for each quantised level up to its own, with
``BITS_PER_ITEM`` bits for each insertion.  The number of slices follows the
input, so the model grows with what is inserted and no n-gram is left out.

Scoring broadcasts the stored segments and reads a count back by probing level
after level until the filter says no.  A model of at most ``PASS_BYTES`` is one
broadcast; a larger one is sent in several passes of a bounded number of
segments, each pass answering the tokens of its hash range, and the answers of
a chunk are put together.  Any documents can be scored, not only those counted.

The model is of order three with back-off: ``p3 = K c(u,v,w)/c(u,v) + (1-K) p2``
where the pair u,v is known, else p2; ``p2 = M c(v,w)/c(v) + (1-M) p1`` where v
is known, else p1; ``p1 = (c(w)+A) / (N + A (V+1))``.  K, M and A are those of
a small grid with the highest leave-one-out likelihood over all training tokens.

Hashes have 64 bits (words of up to eight bytes never collide); a pair or
triple is known by its slice and 32 further bits, well below the filter's own
error.

Defined cases: a null or empty text has the end token only; without training
tokens every count is 0 and both scores follow from N = V = 0; repeated rows
count and are scored as often as they occur; a null doc_id belongs to the
training part; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.llm.runtime import chunk_table, each_row, parts_for, slice_bounds, slice_of, spread_out, squeeze, stored, unpack_rows
from metroscope.llm.words import LOWER, Words, hash_spans, mix, split

MODULUS, HELD_OUT = 7, 2
CHUNK_BYTES = 8 << 20
BITS_PER_ITEM = 10
PROBES = 5
BASE = 1.5                      # quantisation: level j stands for counts from BASE**(j-1)
LEVELS = 64
END, BEGIN = np.uint64(0x454E44), np.uint64(0x424547494E)  # marks besides the words
PASS_BYTES = 80 << 20           # of segments broadcast at once
SLICE_BYTES = 4 << 20           # of stored chunks for every slice, about
HELD = 1 << 22                  # distinct n-grams a task adds up before it sends them
GRID = [(k, m, a) for a in (1.0, 0.25) for m in (0.0, 0.1, 0.3, 0.6) for k in (0.0, 0.3, 0.6)]

_STEPS = np.array([int(np.ceil(BASE ** j - 1e-9)) for j in range(LEVELS)], np.int64)  # first count of level j + 1
_VALUES = np.concatenate([[0.0], [(a + max(a, b - 1)) / 2 for a, b in zip(_STEPS[:-1].tolist(), _STEPS[1:].tolist())]])


def level_of(count: np.ndarray) -> np.ndarray:
    """Quantised level of counts; 0 for 0."""
    return np.searchsorted(_STEPS, count, side="right")


def training(doc_ids: list) -> np.ndarray:
    """Whether each document belongs to the training part."""
    return np.array([d is None or zlib.crc32(str(d).encode()) % MODULUS != HELD_OUT for d in doc_ids], bool)


@dataclass
class Tokens:
    """Tokens of a chunk: hashes in order, those of text i at ``first[i]:first[i+1]`` (the last is END)."""
    hash: np.ndarray
    first: np.ndarray

    @property
    def pair(self) -> np.ndarray:
        """Hash of each token together with the one before it in its text."""
        return mix(self._before(self.hash, BEGIN) * np.uint64(0x9E3779B97F4A7C15) + self.hash, 3)

    @property
    def triple(self) -> np.ndarray:
        """Hash of each token together with the two before it; a text's first token has the one before twice."""
        pair = self.pair
        return mix(self._before(pair, BEGIN) * np.uint64(0xD6E8FEB86659FD93) + self.hash, 4)

    def _before(self, x: np.ndarray, first) -> np.ndarray:
        """The value of the token before; ``first`` at the start of a text."""
        out = np.empty_like(x)
        out[1:] = x[:-1]
        out[self.first[:-1]] = first
        return out


def tokens(texts: pa.StringArray) -> Tokens:
    w = split(texts, "space")
    w = Words(LOWER[w.buf], w.start, w.end, w.first)
    n = len(w.first) - 1
    first = w.first + np.arange(n + 1)
    out = np.full(len(w) + n, END, np.uint64)
    place = np.ones(len(out), bool)
    place[first[1:] - 1] = False
    out[place] = hash_spans(w.buf, w.start, w.end)
    return Tokens(out, first)


# ------------------------------------------------------------------ filter
def _key(h: np.ndarray, order: int) -> np.ndarray:
    """What the filter sees of an n-gram: 32 bits and the order."""
    return mix(h & np.uint64(0xFFFFFFFF), order)


def _bit(key: np.ndarray, level, probe: int, bits) -> np.ndarray:
    a = mix(key ^ (np.asarray(level, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), 11)
    x = (a >> np.uint64(32)) + np.uint64(probe) * ((a & np.uint64(0xFFFFFFFF)) | np.uint64(1))
    return ((x & np.uint64(0xFFFFFFFF)) * bits) >> np.uint64(32)


def build_segment(grams: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, int]:
    """(packed bits, number of bits) for (hashes, counts, order) lists of one slice."""
    levels = [level_of(c) for _, c, _ in grams]
    bits = max(64, sum(int(x.sum()) for x in levels) * BITS_PER_ITEM)
    field = np.zeros(bits, bool)
    for (h, _, order), own in zip(grams, levels):
        key = _key(h, order)
        for level in range(1, int(own.max(initial=0)) + 1):
            k = key[own >= level]
            for probe in range(PROBES):
                field[_bit(k, level, probe, np.uint64(bits))] = True
    return np.packbits(field), bits


@dataclass
class Filter:
    """Segments of the slices ``low`` to ``low + len(bits) - 1`` of ``slices``, one after the other."""
    data: np.ndarray
    start: np.ndarray   # first byte of each slice's segment
    bits: np.ndarray    # its number of bits
    low: int
    slices: int

    def slot(self, h: np.ndarray) -> np.ndarray:
        """Segment of each hash here; below 0 or beyond the last one for a hash of other segments."""
        return slice_of(h, self.slices).astype(np.int64) - self.low

    def inside(self, h: np.ndarray) -> np.ndarray:
        part = self.slot(h)
        return (part >= 0) & (part < len(self.bits))

    def levels(self, h: np.ndarray, order: int) -> np.ndarray:
        """Quantised levels by repeated membership probes."""
        part = self.slot(h)
        key, start, bits = _key(h, order), self.start[part], self.bits[part]
        level, live = np.zeros(len(h), np.uint8), np.arange(len(h))
        for step in range(1, LEVELS):
            for probe in range(PROBES):
                at = _bit(key[live], step, probe, bits[live])
                byte = self.data[start[live] + (at >> np.uint64(3)).astype(np.int64)]
                live = live[(byte >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1 == 1]
            if not len(live):
                break
            level[live] = step
        return level

    def counts(self, h: np.ndarray, order: int) -> np.ndarray:
        """Approximate counts."""
        return _VALUES[self.levels(h, order)]


@dataclass
class Segments:
    """What one broadcast holds: a filter and the exact counts of its slices' words."""
    filter: Filter
    words: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, rows: list, low: int, count: int, slices: int) -> Segments:
        by = {r["slice"]: r for r in rows}
        empty = np.packbits(np.zeros(64, bool)).tobytes()  # of a slice without training n-grams
        data = [np.frombuffer(by[i]["data"] if i in by else empty, np.uint8) for i in range(low, low + count)]
        start = np.cumsum([0, *(len(x) for x in data)])[:-1].astype(np.int64)
        bits = np.array([by[i]["bits"] if i in by else 64 for i in range(low, low + count)], np.uint64)
        kinds = [np.frombuffer(by[i][c], t) for c, t in (("words", np.uint64), ("counts", np.int64)) for i in range(low, low + count) if i in by]
        half = len(kinds) // 2
        join = lambda x, t: np.concatenate([np.zeros(0, t), *x])
        return cls(Filter(join(data, np.uint8), start, bits, low, slices), join(kinds[:half], np.uint64), join(kinds[half:], np.int64))

    def seen(self, h: np.ndarray) -> np.ndarray:
        """Exact counts of words (slices ascend with the hash, so the words are sorted)."""
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, self.counts[at], 0)

    def answers(self, t: Tokens) -> list[np.ndarray]:
        """For the tokens whose hashes lie here: exact counts of their distinct words (in hash order), and in token order levels of words, pairs and triples."""
        kinds, back = np.unique(t.hash[self.filter.inside(t.hash)], return_inverse=True)
        pair, again = np.unique(t.pair[self.filter.inside(t.pair)], return_inverse=True)
        triple = t.triple  # mostly distinct as they are
        return [self.seen(kinds), self.filter.levels(kinds, 1)[back], self.filter.levels(pair, 2)[again], self.filter.levels(triple[self.filter.inside(triple)], 3)]


ANSWERS = [np.int64, np.uint8, np.uint8, np.uint8]


def estimates(t: Tokens, word: np.ndarray, pair: np.ndarray, triple: np.ndarray) -> list[np.ndarray]:
    """Counts of each token, of the token before, of the pair, of the pair before, and of the triple, from levels."""
    c1, c2, c3 = _VALUES[word], _VALUES[pair], _VALUES[triple]
    ends = c1[t.first[1:] - 1]  # as many begins as ends
    before = t._before(c1, ends)
    c2 = np.minimum(c2, np.minimum(c1, before))
    before2 = t._before(c2, ends)
    return [c1, before, c2, before2, np.minimum(c3, np.minimum(c2, before2))]


class Model:
    """Counted on the training rows of ``chunks`` (runtime.chunk_table); its segments are stored."""

    def __init__(self, chunks: DataFrame, pass_bytes: int = PASS_BYTES):
        self.chunks, self.spark = chunks, chunks.sparkSession
        self.slices = n = parts_for(chunks, SLICE_BYTES)

        def count(batches: Iterator[pa.RecordBatch]):
            held, size = [], 0
            for r in each_row(batches):
                ids, texts = unpack_rows(r["data"])
                t = tokens(texts)
                taught = np.repeat(training(ids), np.diff(t.first))
                held.append([np.unique(h[taught], return_counts=True) for h in (t.hash, t.pair, t.triple)])
                size += sum(len(x[0]) for x in held[-1])
                if size > HELD:
                    held = [_added(held)]
                    size = sum(len(x[0]) for x in held[0])
                    if size > HELD // 2:
                        yield _messages(held[0], n)
                        held, size = [], 0
            if held:
                yield _messages(_added(held), n)

        def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = list(each_row(batches))
            (word, seen), *more = (_summed([(np.frombuffer(r[f"h{i}"], t), spread_out(r[f"n{i}"], np.uint32)) for r in rows]) for i, t in zip((1, 2, 3), KEYS))
            segment, bits = build_segment([(word, seen, 1), *((h.astype(np.uint64), c, i) for i, (h, c) in zip((2, 3), more))])
            cols = (key[0].as_py(), bits, segment.tobytes(), word.tobytes(), seen.tobytes(), int(seen.sum()), len(word))
            yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, (pa.int32(), pa.int64(), *[pa.binary()] * 3, pa.int64(), pa.int64()))],
                                             ["slice", "bits", "data", "words", "counts", "total", "distinct"])

        sent = chunks.mapInArrow(count, "slice int, " + ", ".join(f"h{i} binary, n{i} binary" for i in (1, 2, 3)))
        self.segments = stored(sent.groupBy("slice").applyInArrow(add, "slice int, bits long, data binary, words binary, counts binary, total long, distinct long"), "lm-segments")
        size = F.octet_length("data") + F.octet_length("words") + F.octet_length("counts")
        sums = self.segments.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in (F.col("bits"), F.col("total"), F.col("distinct"), size)]).first()
        self.bits, self.total, self.distinct, self.bytes = map(int, sums)
        # hashes spread evenly, so equal runs of slices are about equal in bytes
        self.passes = min(n, max(1, -(-self.bytes // pass_bytes)))
        self.levels = self._levels(chunks)
        self.weights = self._tune()

    def _held(self, part: int):
        """The segments of one pass, broadcast."""
        low, high = (self.slices * i // self.passes for i in (part, part + 1))
        rows = self.segments.filter((F.col("slice") >= low) & (F.col("slice") < high)).select("slice", "bits", "data", "words", "counts").collect()
        return self.spark.sparkContext.broadcast(Segments.of(rows, low, high - low, self.slices))

    def _levels(self, chunks: DataFrame) -> DataFrame:
        """Of each chunk, stored once: doc_ids, first token of each text, levels of tokens, pairs and triples, known tokens and
        base score of each text, and the leave-one-out likelihoods of the grid."""
        rest, total, distinct, passes, slices = np.log10(self.total + self.distinct + 1.0), self.total, self.distinct, self.passes, self.slices
        names = ["ids", "first", "word", "pair", "triple", "known", "base", "sums"]
        types = [pa.list_(pa.int64()), *[pa.binary()] * 6, pa.list_(pa.float64())]

        def whole(data: bytes, parts: list[tuple[int, list[np.ndarray]]]) -> list:
            ids, texts = unpack_rows(data)
            t = tokens(texts)
            found, places = [np.zeros(len(t.hash), x) for x in ANSWERS], [slice_of(h, slices) for h in (t.hash, t.pair, t.triple)]
            for part, answers in parts:
                low, high = (slices * i // passes for i in (part, part + 1))
                inside = [(at >= low) & (at < high) for at in places]
                _, back = np.unique(t.hash[inside[0]], return_inverse=True)
                for out, own, at in zip(found, [answers[0][back], *answers[1:]], [inside[0], *inside]):
                    out[at] = own
            exact, *levels = found
            per_text = lambda v: np.add.reduceat(v, t.first[:-1])  # noqa: E731  every text has its end token
            base = per_text(np.log10(exact + 1.0)) - np.diff(t.first) * rest
            use = np.repeat(training(ids), np.diff(t.first))
            # single precision decides between the grid's points
            others = [np.maximum(x[use] - 1, 0).astype(np.float32) for x in estimates(t, *levels)]
            sums = [float(np.log10(p).sum(dtype=np.float64)) for p in probabilities(others, total, distinct, GRID)]
            return [ids, *map(squeeze, (t.first.astype(np.int64), *levels, per_text((exact > 0).astype(np.int64)), base)), sums]

        schema = "ids array<long>, first binary, word binary, pair binary, triple binary, known binary, base binary, sums array<double>"
        partial = "chunk long, part int, a0 binary, a1 binary, a2 binary, a3 binary"
        tables = []
        for part in range(passes):  # one broadcast at a time
            held = self._held(part)

            def probe(batches: Iterator[pa.RecordBatch], held=held, part=part):
                for r in each_row(batches):
                    cols = [r["chunk"], part, *map(squeeze, held.value.answers(tokens(unpack_rows(r["data"])[1])))]
                    yield pa.RecordBatch.from_arrays([pa.array([c], x) for c, x in zip(cols, (pa.int64(), pa.int32(), *[pa.binary()] * 4))],
                                                     ["chunk", "part", "a0", "a1", "a2", "a3"])

            tables.append(stored(chunks.mapInArrow(probe, partial), "pass-levels"))
            held.destroy()

        def combine(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return pa.table([pa.array([], x) for x in types], names)
            parts = [(r["part"], [spread_out(r[f"a{i}"], x) for i, x in enumerate(ANSWERS)]) for r in right.to_pylist()]
            return pa.table([pa.array([c], x) for c, x in zip(whole(left.column("data")[0].as_py(), parts), types)], names)

        answers = reduce(DataFrame.unionByName, tables)
        return stored(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(combine, schema), "token-levels")

    def _tune(self) -> tuple[float, float, float]:
        """The grid's weights of the highest leave-one-out likelihood over all training tokens."""
        best = self.levels.agg(*[F.sum(F.col("sums")[i]) for i in range(len(GRID))]).first()
        return GRID[max(range(len(GRID)), key=lambda i: -np.inf if best[i] is None else best[i])]

    def score(self, docs: DataFrame | None = None) -> DataFrame:
        """One row per document (of the counted ones, or of ``docs``): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
        levels = self.levels if docs is None else self._levels(chunk_table(docs, "lm-chunks", CHUNK_BYTES))
        total, distinct, weights = self.total, self.distinct, self.weights
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        types = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]

        def run(batches: Iterator[pa.RecordBatch]):
            for r in each_row(batches):
                ids, t = r["ids"], Tokens(np.zeros(0, np.uint64), spread_out(r["first"], np.int64))
                p = next(probabilities(estimates(t, *(spread_out(r[c], np.uint8) for c in ("word", "pair", "triple"))), total, distinct, [weights]))
                cols = (ids, ~training(ids), np.diff(t.first), spread_out(r["known"], np.int64), np.full(len(ids), total),
                        spread_out(r["base"], np.float64), np.add.reduceat(np.log10(p), t.first[:-1]))
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, types)], names)

        return levels.select("ids", "first", "word", "pair", "triple", "known", "base").mapInArrow(
            run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


# what a slice's task sees of words, pairs and triples
KEYS = (np.uint64, np.uint32, np.uint32)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of all parts with their counts added up."""
    kinds, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    return kinds, np.bincount(back, np.concatenate([c for _, c in parts]), len(kinds)).astype(np.int64)


def _added(held: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """The counts of several chunks as one list per order."""
    return held[0] if len(held) == 1 else [_summed([x[i] for x in held]) for i in range(3)]


def _messages(counts: list[tuple[np.ndarray, np.ndarray]], n: int) -> pa.RecordBatch:
    """One row per hash slice with anything in it: keys and counts of words, pairs and triples."""
    cut = [slice_bounds(h, n) for h, _ in counts]
    rows = []
    for i in np.flatnonzero(sum(np.diff(c) for c in cut)).tolist():
        row = [i]
        for (h, c), at, kind in zip(counts, cut, KEYS):
            own = h[at[i]:at[i + 1]]
            row += [(own if kind is np.uint64 else (own & np.uint64(0xFFFFFFFF)).astype(kind)).tobytes(), squeeze(c[at[i]:at[i + 1]].astype(np.uint32))]
        rows.append(row)
    cols = list(zip(*rows)) or [[]] * 7
    return pa.RecordBatch.from_arrays([pa.array(v, x) for v, x in zip(cols, (pa.int32(), *[pa.binary()] * 6))], ["slice", "h1", "n1", "h2", "n2", "h3", "n3"])


def probabilities(counts: list[np.ndarray], total: int, distinct: int, grid: list[tuple[float, float, float]]) -> Iterator[np.ndarray]:
    """Probabilities of tokens from ``estimates``, for each (K, M, A) of ``grid``."""
    word, before, pair, before2, triple = counts
    one = word.dtype.type
    second, third = (np.where(under > 0, over / np.maximum(under, one(1e-9)), one(-1)) for over, under in ((pair, before), (triple, before2)))
    for k, m, a in grid:
        p1 = np.minimum((word + one(a)) / one(total + a * (distinct + 1)), one(1))
        p2 = np.where(second >= 0, one(m) * second + one(1 - m) * p1, p1)
        yield np.where(third >= 0, one(k) * third + one(1 - k) * p2, p2)


def score(docs: DataFrame) -> DataFrame:
    """Train on the training part of ``docs`` and score all rows."""
    return Model(chunk_table(docs, "lm-chunks", CHUNK_BYTES)).score()

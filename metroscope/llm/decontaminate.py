"""Benchmark decontamination with an FM-index per training shard.

The test items' windows (ten consecutive words; an item of fewer words is one
window) are the phrases.  A shard is a bounded block of training documents.
Its words are numbered by the phrases' vocabulary; a word outside it ends a
run, since no phrase can lie across it, and only runs long enough for a phrase
are indexed.  Over these runs the shard builds a suffix array, the
Burrows-Wheeler transform in a wavelet matrix with ranks, and suffix positions
sampled at regular text positions.  All phrases are searched backward at once;
occurrences are located by stepping to the next sampled position; the spans
found are merged to removal spans per document.

Phrases are broadcast in blocks of about ``BLOCK_WORDS`` item words (one item
is never split), one pass over the shards per block: a block is searched, its
findings are stored, its broadcast is given up, and only then the next block
is built, so driver and workers hold one block however many items there are.
With one block nothing is stored or shuffled.

Defined cases: a null text has no words; an item without words never matches;
equal items are found alike; repeated document rows are judged each by itself;
an empty benchmark leaves everything clean; other columns pass through
``remove_spans`` unchanged (``n_chars``, where present as a number, follows the
new text).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.llm.runtime import blocks, doc_text, plain, quoted, raw_text, stored, string_column
from metroscope.llm.words import split

WINDOW = 10
BLOCK_WORDS = 2_000_000   # item words broadcast at a time
SAMPLE_EVERY = 16         # text positions whose suffix rank is kept
SHARD_BYTES = 8 << 20     # text bytes of a shard


# ------------------------------------------------------------------ FM-index
def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; only suffixes that still tie are sorted again."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    rank = np.empty(n, np.int64)
    ordered = text[order]
    new = np.ones(n, bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # rank = first row of the group
    rank[order] = group
    width = 1
    while width < n:
        same = np.zeros(n, bool)
        same[1:] = group[1:] == group[:-1]
        same[:-1] |= same[1:]
        tied = np.flatnonzero(same)
        if not len(tied):
            break
        at = order[tied]
        ahead = np.where(at + width < n, rank[np.minimum(at + width, n - 1)] + 1, 0)
        inner = np.lexsort((ahead, group[tied]))
        order[tied] = at[inner]
        g, a = group[tied][inner], ahead[inner]
        fresh = np.ones(len(tied), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (a[1:] != a[:-1])
        group[tied] = np.maximum.accumulate(np.where(fresh, tied, 0))
        rank[order[tied]] = group[tied]
        width *= 2
    return order


class WaveletMatrix:
    """Symbol sequence with vectorised access and rank."""

    def __init__(self, seq: np.ndarray, symbols: int):
        self.n, self.bits = len(seq), max(1, int(symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (seq >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(int(self.n - bit.sum()))
            seq = np.concatenate([seq[bit == 0], seq[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        low, high = np.zeros(len(at), np.int64), at.astype(np.int64)
        for k, (ones, zeros) in enumerate(zip(self.ones, self.zeros)):
            bit = ((symbol >> (self.bits - 1 - k)) & 1).astype(bool)
            o_low, o_high = ones[low], ones[high]
            low, high = np.where(bit, zeros + o_low, low - o_low), np.where(bit, zeros + o_high, high - o_high)
        return high - low

    def access(self, at: np.ndarray) -> np.ndarray:
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for ones, zeros in zip(self.ones, self.zeros):
            bit = ones[at + 1] - ones[at]
            out = out << 1 | bit
            at = np.where(bit == 1, zeros + ones[at], at - ones[at])
        return out


class FMIndex:
    """Index of a symbol sequence; symbol 0 ends the sequence and occurs only there."""

    def __init__(self, text: np.ndarray, symbols: int, every: int = SAMPLE_EVERY):
        sa = suffix_array(text)
        self.n = len(text)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=symbols))])
        self.bwt = WaveletMatrix(text[sa - 1], symbols)  # row of suffix 0 holds the last symbol
        sampled = sa % every == 0
        self.marked = np.concatenate([[0], np.cumsum(sampled)]).astype(np.int32)
        self.position = sa[sampled]

    def search(self, phrases: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of all phrases (padded matrix, lengths) by backward search."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((length > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, length[live] - 1 - step]
            low[live] = self.before[symbol] + self.bwt.rank(symbol, low[live])
            high[live] = self.before[symbol] + self.bwt.rank(symbol, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each row: step back to a sampled one, count the steps."""
        rows, out, steps = rows.astype(np.int64), np.empty(len(rows), np.int64), 0
        live = np.arange(len(rows))
        while len(live):
            hit = self.marked[rows + 1] > self.marked[rows]
            out[live[hit]] = self.position[self.marked[rows[hit]]] + steps
            live, rows = live[~hit], rows[~hit]
            if len(live):
                symbol = self.bwt.access(rows)
                rows = self.before[symbol] + self.bwt.rank(symbol, rows)
            steps += 1
        return out


# ------------------------------------------------------------------ phrases
class Phrases:
    """Windows of a block of items over a numbered vocabulary (numbers from 2; 0 ends a shard, 1 ends a run)."""

    def __init__(self, item_ids: list, texts: list, window: int):
        w = split(pa.array([t or "" for t in texts], pa.string()), "alnum")
        h = w.hashes()
        self.vocabulary = np.unique(h)
        number = np.searchsorted(self.vocabulary, h) + 2
        rows, items = [], []
        for i, item in enumerate(item_ids):
            own = number[w.first[i]:w.first[i + 1]]
            for s in range(max(1, len(own) - window + 1) if len(own) else 0):
                rows.append(own[s:s + window])
                items.append(i)
        self.item_ids = list(item_ids)
        table = np.zeros((len(rows), window + 1), np.int64)  # padded phrase, then its length
        for i, r in enumerate(rows):
            table[i, :len(r)], table[i, -1] = r, len(r)
        # equal windows are searched once
        table, back = np.unique(table, axis=0, return_inverse=True)
        self.matrix, self.length, back = table[:, :-1], table[:, -1], back.ravel()
        order = np.argsort(back, kind="stable")
        self.owners = np.array(items, int)[order]  # items of each window, one window after the other
        self.owned = np.concatenate([[0], np.cumsum(np.bincount(back, minlength=len(self.length)))]).astype(int)
        self.shortest = int(self.length.min()) if len(self.length) else 0


def _find(texts: pa.StringArray, phrases: Phrases):
    """Per text of a shard: number of words, hit spans as word ranges (owner, start, end), items (owner, item)."""
    w = split(texts, "alnum")
    none = np.zeros(0, np.int64)
    if not len(phrases.length) or not len(w):
        return w, (none, none, none), (none, none)
    h = w.hashes()
    at = np.minimum(np.searchsorted(phrases.vocabulary, h), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == h
    owner = w.owner()
    # runs of known words inside a text that are long enough for a phrase
    head = known.copy()
    head[1:] &= ~(known[:-1] & (owner[1:] == owner[:-1]))
    tail = known.copy()
    tail[:-1] &= ~(known[1:] & (owner[1:] == owner[:-1]))
    start, end = np.flatnonzero(head), np.flatnonzero(tail) + 1
    long = end - start >= phrases.shortest
    start, end = start[long], end[long]
    if not len(start):
        return w, (none, none, none), (none, none)
    size = end - start
    new_at = np.cumsum(size + 1) - (size + 1)     # each run, then the run-end symbol
    word = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    place = word - np.repeat(start - new_at, size)
    text = np.ones(int((size + 1).sum()) + 1, np.int64)
    text[-1] = 0
    text[place] = at[word] + 2
    source = np.zeros(len(text), np.int64)
    source[place] = word
    index = FMIndex(text, len(phrases.vocabulary) + 2)
    low, high = index.search(phrases.matrix, phrases.length)
    count = high - low
    found = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())
    first = source[index.locate(rows)]
    doc = owner[first]
    # items: every (text, window) once, then the window's items
    pair = np.unique(doc * len(count) + found)
    d, p = pair // max(1, len(count)), pair % max(1, len(count))
    each = phrases.owned[p + 1] - phrases.owned[p]
    item = phrases.owners[np.repeat(phrases.owned[p] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
    return w, (doc, first, first + phrases.length[found]), (np.repeat(d, each), item)


def merge_spans(start: np.ndarray, end: np.ndarray) -> list[tuple[int, int]]:
    """Union of word ranges as disjoint ranges in order."""
    order = np.lexsort((end, start))
    out: list[list[int]] = []
    for s, e in zip(start[order].tolist(), end[order].tolist()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def by_text(owner: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each text number that occurs, with the places where it does."""
    order = np.argsort(owner, kind="stable")
    ids, at = np.unique(owner[order], return_index=True)
    yield from zip(ids.tolist(), np.split(order, at[1:]))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def block_count(benchmark: DataFrame, block_words: int = BLOCK_WORDS) -> int:
    """In how many blocks of about ``block_words`` words the benchmark is searched (at least one)."""
    size = _items(benchmark).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return 1 + size // (4 * block_words)


def phrases_of(benchmark: DataFrame, k: int, n: int, window: int = WINDOW) -> Phrases:
    """The windows of block ``k`` of ``n``."""
    rows = _items(benchmark).filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect()  # one bounded block
    rows.sort(key=lambda r: (str(r.item_id), r.text))
    return Phrases([r.item_id for r in rows], [r.text for r in rows], window)


FOUND = "n_words long, spans array<struct<start:int,end:int>>, items array<string>"


def _search(docs: DataFrame, held, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with n_words, merged spans and items of one broadcast block of phrases."""
    schema = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.select(*map(quoted, keep)).schema) + ", " + FOUND
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]):
        phrases = held.value
        for b in blocks(batches, limit=SHARD_BYTES):
            w, (doc, start, end), (who, item) = _find(string_column(b, "text"), phrases)
            spans, items = [[] for _ in range(b.num_rows)], [[] for _ in range(b.num_rows)]
            for d, own in by_text(doc):
                spans[d] = [{"start": s, "end": e} for s, e in merge_spans(start[own] - w.first[d], end[own] - w.first[d])]
            for d, own in by_text(who):
                items[d] = sorted({str(phrases.item_ids[i]) for i in item[own].tolist() if phrases.item_ids[i] is not None})
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(w.counts, pa.int64()), pa.array(spans, span),
                                              pa.array(items, pa.list_(pa.string()))], [*keep, "n_words", "spans", "items"])

    return docs.mapInArrow(run, schema)


def _search_blocks(numbered: DataFrame, benchmark: DataFrame, n: int, window: int, keep: list[str]) -> DataFrame:
    """Findings of ``n`` blocks, one block after the other, each stored before the next is built."""
    whole = None
    for k in range(n):
        held = numbered.sparkSession.sparkContext.broadcast(phrases_of(benchmark, k, n, window))
        part = stored(_search(numbered, held, keep), "phrase-block")
        held.destroy()  # its findings are files now
        whole = part if whole is None else whole.unionByName(part)
    return whole


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, spans (merged word ranges), items (sorted ids as strings)."""
    docs, n = doc_text(docs), block_count(benchmark, block_words)
    if n == 1:
        return _search(docs, docs.sparkSession.sparkContext.broadcast(phrases_of(benchmark, 0, 1, window)), ["doc_id"])
    # several blocks: rows are numbered once in a stored copy, then each row's findings are joined
    docs = stored(docs.withColumn("row", F.monotonically_increasing_id()), "numbered")
    whole = _search_blocks(docs, benchmark, n, window, ["row", "doc_id"])
    spans = F.flatten(F.collect_list("spans"))
    return whole.groupBy("row", "doc_id").agg(
        F.max("n_words").alias("n_words"), F.array_sort(spans).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("row")


def report(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated from the rows of ``find``."""
    # ranges may overlap between blocks of phrases: count each word once
    acc = F.aggregate(F.array_sort("spans"), F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
                      lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["end"] - F.greatest(s["start"], a["upto"]))).alias("n"),
                                            F.greatest(a["upto"], s["end"]).alias("upto")))
    return found.select("doc_id", "n_words", acc["n"].cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"),
                        (F.size("spans") > 0).alias("contaminated"))


def _cut(b: pa.RecordBatch, w, hits: dict[int, list], chars: str | None) -> pa.RecordBatch:
    """The batch with the word ranges ``hits`` of its rows cut out of the text; ``w`` are its words."""
    if not hits:
        return b
    texts = string_column(b, "text")
    (_, offsets), values, gone = raw_text(texts), b.column("text").to_pylist(), set()  # a null text stays null
    lengths = b.column(chars).to_pylist() if chars else None
    for d, spans in hits.items():
        merged = merge_spans(*(np.array(x) for x in zip(*spans)))
        if sum(e - s for s, e in merged) == w.counts[d]:
            gone.add(d)
            continue
        raw, parts, upto = values[d].encode(), [], 0
        base, first = int(offsets[d]), int(w.first[d])
        for s, e in merged:
            parts.append(raw[upto:int(w.start[first + s]) - base])
            upto = int(w.end[first + e - 1]) - base
        parts.append(raw[upto:])
        values[d] = "\n".join(t for t in (p.decode().strip() for p in parts) if t)
        if lengths:
            lengths[d] = len(values[d])
    cols = {"text": pa.array(values, b.column("text").type)} | ({chars: pa.array(lengths, b.column(chars).type)} if chars else {})
    out = pa.RecordBatch.from_arrays([cols.get(c, b.column(c)) for c in b.schema.names], b.schema.names)
    return out.filter(pa.array([i not in gone for i in range(b.num_rows)])) if gone else out


def remove_spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The documents with every hit word range cut out of the text, all columns.

    The text before and after a cut is joined by a line break.  A document
    whose words were all hit is dropped; one without hits is unchanged, byte
    for byte.  With several blocks of phrases each is searched in the original
    text, and all ranges of a document are cut together.
    """
    names, docs, n = docs.columns, plain(docs), block_count(benchmark, block_words)
    schema = docs.schema
    chars = next((f.name for f in schema if f.name == "n_chars" and f.dataType.typeName() in ("long", "integer")), None)
    if n == 1:
        held = docs.sparkSession.sparkContext.broadcast(phrases_of(benchmark, 0, 1, window))

        def run(batches: Iterator[pa.RecordBatch]):
            for b in blocks(batches, limit=SHARD_BYTES):
                w, (doc, start, end), _ = _find(string_column(b, "text"), held.value)
                yield _cut(b, w, {d: list(zip((start[own] - w.first[d]).tolist(), (end[own] - w.first[d]).tolist()))
                                  for d, own in by_text(doc)}, chars)

        return docs.mapInArrow(run, schema).toDF(*names)
    mark = "__c" + hashlib.md5("|".join(docs.columns).encode()).hexdigest()[:8]
    row, spans = f"{mark}r", f"{mark}s"
    numbered = stored(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    hits = (_search_blocks(numbered.select(row, "text"), benchmark, n, window, [row]).filter(F.size("spans") > 0)
            .groupBy(row).agg(F.flatten(F.collect_list("spans")).alias(spans)))
    whole = numbered.join(hits, row, "left").select(*map(quoted, docs.columns), spans)

    def cut(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches, limit=SHARD_BYTES):
            own = {i: [(s["start"], s["end"]) for s in found] for i, found in enumerate(b.column(spans).to_pylist()) if found}
            rows = b.drop_columns([spans])
            yield _cut(rows, split(string_column(b, "text"), "alnum") if own else None, own, chars)

    return whole.mapInArrow(cut, schema).toDF(*names)

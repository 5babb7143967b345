"""Line deduplication by probing a sharded minimal perfect hash.

A line's key is the line without ASCII white space at both ends, A-Z
lower-cased.  Keys of at least ``min_chars`` code points found in at least
``min_docs`` documents lose all their lines except in the largest doc_id that
holds them.

1. Counts.  Each block of texts reduces its keys to (two 64-bit hashes, number
   of documents, largest doc_id); Spark adds these up by hash, so a line that a
   third of all documents share is one row per block.  Lines never travel.
2. Index.  The distinct hashes found often enough are dealt to shards by hash;
   the number of shards follows their number.  A shard is one task's minimal
   perfect hash (levels of bit arrays: a key sits at the first level where no
   other key of that level shares its bit, its slot is the rank of the bit) over
   compact arrays: 64-bit fingerprint, saturating 16-bit count, keeper.
3. Probe.  Documents look their lines up in the arrays instead of joining.  An
   index of at most ``MOST_BYTES`` is broadcast and texts are rewritten in the
   same pass.  A larger one is broadcast in groups of shards, one group at a
   time: the documents' hashes, stored by group, are probed group by group, and
   the answers (positions of dropped lines) meet the texts by chunk.

A key is known by 128 bits: the slot comes from both hashes, the fingerprint is
the second one.

Defined cases: a null or empty text is one empty line; "\\r" is white space, not
a line end; rows that repeat a doc_id count as documents of their own, and all
of them keep the lines that this doc_id keeps; a null doc_id is the smallest; a
document that loses every line has an empty text; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.llm.runtime import blocks, chunk_table, doc_text, each_row, raw_text, scratch, spread_out, squeeze, stored, string_column, unpack_rows
from metroscope.llm.words import LOWER, NOT_SPACE, hash_spans, mix

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 20        # keys of a shard, about
MOST_BYTES = 96 << 20       # of the index, broadcast at once
LONG_LINE = 4096            # bytes from which a key is hashed in one piece
COUNT_MAX = (1 << 16) - 1
INDEX = "shard int, n long, sizes array<long>, bits binary, fingers binary, counts binary, keepers binary, known binary"
RESULT = "doc_id long, n_lines long, n_dropped long, kept_text string"


# ------------------------------------------------------------------ lines
@dataclass
class Lines:
    """Lines of a block: ``buf[start:end]`` without the line end; those of text i are ``first[i]:first[i+1]``.

    ``at`` names the lines long enough to count, ``h`` and ``f`` are their keys' hashes.
    """
    buf: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    at: np.ndarray
    h: np.ndarray
    f: np.ndarray

    def owner(self) -> np.ndarray:
        """Text number of each line in ``at``."""
        return np.searchsorted(self.first, self.at, side="right") - 1


def lines(texts: pa.StringArray, min_chars: int) -> Lines:
    buf, off = raw_text(pc.binary_join_element_wise(texts, "", "\n"))  # an end after every last line
    end = np.flatnonzero(buf == 0x0A)
    start = np.concatenate([np.zeros(min(1, len(end)), np.int64), end[:-1] + 1])
    solid = np.flatnonzero(NOT_SPACE[buf])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    at = np.flatnonzero(a < b)
    left, right = solid[a[at]], solid[b[at] - 1] + 1
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    long = chars[right] - chars[left] >= min_chars
    at, left, right = at[long], left[long], right[long]
    h, f = key_hashes(LOWER[buf], left, right)
    return Lines(buf, start, end, np.searchsorted(end, off), at, h, f)


def key_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every span."""
    h, f = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    short = end - start < LONG_LINE
    h[short], f[short] = (hash_spans(buf, start[short], end[short], seed) for seed in (0, 0x5EED))
    for i in np.flatnonzero(~short).tolist():
        h[i], f[i] = np.frombuffer(hashlib.blake2b(buf[start[i]:end[i]].tobytes(), digest_size=16).digest(), np.uint64)
    return h, f


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts by the keys, and the first place of each distinct key in it."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    return order, np.flatnonzero(new)


def key_counts(docs: DataFrame, min_chars: int) -> DataFrame:
    """Of each distinct key: h, f, number of documents n, largest doc_id keep."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches):
            own = lines(string_column(b, "text"), min_chars)
            text = own.owner()
            order, first = _groups(text, own.f, own.h)  # a document counts once
            h, f, text = own.h[order][first], own.f[order][first], text[order][first]
            ids = b.column("doc_id")
            known = ids.is_valid().to_numpy(zero_copy_only=False)[text]
            doc = np.where(known, ids.fill_null(0).to_numpy()[text], np.iinfo(np.int64).min)
            order, first = _groups(f, h)
            if len(first):
                n = np.diff(np.append(first, len(order)))
                keep, some = np.maximum.reduceat(doc[order], first), np.logical_or.reduceat(known[order], first)
                yield pa.RecordBatch.from_arrays([pa.array(h[order][first].view(np.int64)), pa.array(f[order][first].view(np.int64)), pa.array(n),
                                                  pa.array(keep, mask=~some)], ["h", "f", "n", "keep"])

    return (doc_text(docs).mapInArrow(run, "h long, f long, n long, keep long")
            .groupBy("h", "f").agg(F.sum("n").alias("n"), F.max("keep").alias("keep")))


# ------------------------------------------------------------------ minimal perfect hash
def _place(h: np.ndarray, f: np.ndarray, level: int, size: int) -> np.ndarray:
    """Bit of each key at a level of ``size`` bits (at most 2**32)."""
    x = mix(mix(h, 2 * level + 1) ^ f, 2 * level + 2)
    return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def build_hash(h: np.ndarray, f: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(bits of each level, packed bits of all levels) of a minimal perfect hash of distinct (h, f)."""
    sizes, fields = [], []
    while len(h):
        size = max(64, -(-2 * len(h) // 64) * 64)  # about two bits a key, whole 64-bit words
        at = _place(h, f, len(sizes), size).astype(np.int64)
        field = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        fields.append(field)
        rest = ~field[at]
        h, f = h[rest], f[rest]
    return sizes, np.packbits(np.concatenate([np.zeros(0, bool), *fields]), bitorder="little")


class PerfectHash:
    """Slots of the keys a minimal perfect hash was built over; other keys get any slot or -1."""

    def __init__(self, sizes: list[int], bits: np.ndarray | bytes):
        self.sizes, self.words = list(sizes), np.frombuffer(bits, "<u8")
        self.rank = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])  # set bits before each word

    def slots(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        slot, live, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
        for level, size in enumerate(self.sizes):
            if not len(live):
                break
            at = _place(h[live], f[live], level, size) + np.uint64(base)
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            own = self.words[word]
            here = (own >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(own & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            slot[live[here]] = (self.rank[word] + below)[here]
            live, base = live[~here], base + size
        return slot


class Shard:
    """One stored shard: a minimal perfect hash and the arrays its slots index."""

    def __init__(self, row: dict):
        self.hash = PerfectHash(row["sizes"], row["bits"])
        self.fingers, self.counts = np.frombuffer(row["fingers"], np.uint64), np.frombuffer(row["counts"], np.uint16)
        self.keepers, self.known = np.frombuffer(row["keepers"], np.int64), np.frombuffer(row["known"], bool)

    def slots(self, h: np.ndarray, f: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for a key that is not in the shard."""
        slot = self.hash.slots(h, f)
        hit = np.flatnonzero(slot >= 0)
        slot[hit[self.fingers[slot[hit]] != f[hit]]] = -1
        return slot


def build_index(counts: DataFrame, floor: int, shard_keys: int = SHARD_KEYS) -> DataFrame:
    """Shards over the keys found in at least ``floor`` documents, stored once; one row each."""
    often = stored(counts.filter(F.col("n") >= floor), "line-keys")
    shards = max(1, -(-often.count() // shard_keys))

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches))  # a hash slice: bounded, whatever the input
        h, f = (rows.column(c).to_numpy().view(np.uint64) for c in ("h", "f"))
        sizes, bits = build_hash(h, f)
        at = np.empty(len(h), np.int64)
        at[PerfectHash(sizes, bits).slots(h, f)] = np.arange(len(h))  # key of each slot
        arrays = (f, np.minimum(rows.column("n").to_numpy(), COUNT_MAX).astype(np.uint16),
                  rows.column("keep").fill_null(0).to_numpy(), rows.column("keep").is_valid().to_numpy())
        cols = [key[0].as_py(), len(h), sizes, bits.tobytes(), *(a[at].tobytes() for a in arrays)]
        types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, types)],
                                         ["shard", "n", "sizes", "bits", "fingers", "counts", "keepers", "known"])

    dealt = often.withColumn("shard", F.pmod("h", F.lit(shards)).cast("int"))
    return stored(dealt.groupBy("shard").applyInArrow(build, INDEX), "line-index")


# ------------------------------------------------------------------ probing
class LineIndex:
    """The stored index over all of ``docs``; counts are exact up to 65,535 and saturate there.

    ``floor`` is the least number of documents a key must have to be indexed;
    any threshold from it up to 65,535 can be applied when probing.
    """

    def __init__(self, docs: DataFrame, floor: int = MIN_DOCS, min_chars: int = MIN_CHARS, shard_keys: int = SHARD_KEYS):
        if not 1 <= floor <= COUNT_MAX:
            raise ValueError(f"floor must be 1 to {COUNT_MAX}")
        self.spark, self.min_chars, self.floor = docs.sparkSession, min_chars, floor
        self.table = build_index(key_counts(docs, min_chars), floor, shard_keys)
        size = sum((F.octet_length(c) for c in ("bits", "fingers", "counts", "keepers", "known")), F.lit(0))
        # a row of three numbers for every million keys
        self.sizes = {r["shard"]: (r["n"], r["bytes"]) for r in self.table.select("shard", "n", size.alias("bytes")).collect()}
        # keys were dealt to as many shards as the build counted; a shard without keys has no row
        self.shards = max(1, -(-sum(n for n, _ in self.sizes.values()) // shard_keys))

    def groups(self, most_bytes: int) -> list[list[int]]:
        """Shard numbers in groups of at most ``most_bytes`` (or one shard)."""
        out, size = [], 0
        for shard, (_, n) in sorted(self.sizes.items()):
            if not out or size + n > most_bytes:
                out.append([])
                size = 0
            out[-1].append(shard)
            size += n
        return out

    def load(self, group: list[int]):
        """The shards of one group, broadcast."""
        rows = self.table.filter(F.col("shard").isin(group)).collect()  # at most the bound of a group
        return self.spark.sparkContext.broadcast({r["shard"]: r.asDict() for r in rows})


def _gone(shards: dict, n_shards: int, h: np.ndarray, f: np.ndarray, doc: np.ndarray, known: np.ndarray, min_docs: int) -> np.ndarray:
    """Whether each line (its hashes, its document's doc_id and whether that is not null) is dropped."""
    out = np.zeros(len(h), bool)
    own = (h.view(np.int64) % n_shards).astype(np.int64)  # as pmod
    for number, row in shards.items():
        at = np.flatnonzero(own == number)
        if not len(at):
            continue
        shard = row if isinstance(row, Shard) else Shard(row)
        slot = shard.slots(h[at], f[at])
        at, slot = at[slot >= 0], slot[slot >= 0]
        keeper = (shard.known[slot] == known[at]) & (~known[at] | (shard.keepers[slot] == doc[at]))
        out[at] = (shard.counts[slot] >= min_docs) & ~keeper
    return out


def _owners(own: Lines, ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """doc_id of each line in ``at``, and whether it is not null."""
    text = own.owner()
    return ids.fill_null(0).to_numpy(zero_copy_only=False)[text], ids.is_valid().to_numpy(zero_copy_only=False)[text]


def _rewrite(ids: pa.Array, own: Lines, gone: np.ndarray) -> pa.RecordBatch:
    """Result rows of a block whose lines ``gone`` (numbers) are dropped."""
    drop = np.zeros(len(own.end), bool)
    drop[gone] = True
    edge = np.zeros(len(own.buf) + 1, np.int8)
    np.add.at(edge, own.start[~drop], 1)
    np.add.at(edge, own.end[~drop] + 1, -1)
    left = own.buf[np.cumsum(edge[:-1], dtype=np.int8) > 0].tobytes()  # kept lines, each with its line end
    size = np.concatenate([[0], np.cumsum((own.end + 1 - own.start) * ~drop)])[own.first]
    kept = [left[a:b - 1 if b > a else b].decode() for a, b in zip(size[:-1].tolist(), size[1:].tolist())]
    dropped = np.diff(np.concatenate([[0], np.cumsum(drop)])[own.first])
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(own.first), pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())],
                                      ["doc_id", "n_lines", "n_dropped", "kept_text"])


def drop_lines(docs: DataFrame, index: LineIndex, min_docs: int = MIN_DOCS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per document: doc_id, n_lines (before dropping), n_dropped, kept_text."""
    if not index.floor <= min_docs <= COUNT_MAX:
        raise ValueError(f"this index answers thresholds from {index.floor} to {COUNT_MAX}")
    groups = index.groups(most_bytes)
    if len(groups) > 1:
        return _drop_by_groups(docs, index, min_docs, groups)
    held, n_shards, min_chars = index.load(groups[0]) if groups else None, index.shards, index.min_chars

    def run(batches: Iterator[pa.RecordBatch]):
        shards = {k: Shard(r) for k, r in held.value.items()} if held else {}
        for b in blocks(batches):
            own = lines(string_column(b, "text"), min_chars)
            yield _rewrite(b.column("doc_id"), own, own.at[_gone(shards, n_shards, own.h, own.f, *_owners(own, b.column("doc_id")), min_docs)])

    return doc_text(docs).mapInArrow(run, RESULT)


def _drop_by_groups(docs: DataFrame, index: LineIndex, min_docs: int, groups: list[list[int]]) -> DataFrame:
    """The same rows with an index too large for one broadcast."""
    spark, n_shards, min_chars = index.spark, index.shards, index.min_chars
    chunks = chunk_table(docs, "line-chunks")
    group_of = np.full(n_shards, -1, np.int64)
    for g, members in enumerate(groups):
        group_of[members] = g

    def keys(batches: Iterator[pa.RecordBatch]):
        for r in each_row(batches):
            ids, texts = unpack_rows(r["data"])
            own = lines(texts, min_chars)
            doc, known = _owners(own, pa.array(ids, pa.int64()))
            group = group_of[own.h.view(np.int64) % n_shards]
            for g in np.unique(group[group >= 0]).tolist():
                at = group == g
                cols = [g, r["chunk"], own.at[at].astype(np.int64), own.h[at], own.f[at], doc[at], known[at]]
                yield pa.RecordBatch.from_arrays([pa.array([cols[0]], pa.int32()), pa.array([cols[1]], pa.int64()), *(pa.array([squeeze(c)], pa.binary()) for c in cols[2:])],
                                                 ["part", "chunk", "at", "h", "f", "doc", "known"])

    schema = "part int, chunk long, at binary, h binary, f binary, doc binary, known binary"
    asked, told = scratch(spark, "line-hashes"), scratch(spark, "dropped-lines")
    chunks.mapInArrow(keys, schema).write.partitionBy("part").parquet(asked)
    asked = spark.read.schema(schema).parquet(asked)
    for g, members in enumerate(groups):  # each reads its own folder of hashes
        held = index.load(members)

        def probe(batches: Iterator[pa.RecordBatch], held=held):
            shards = {k: Shard(r) for k, r in held.value.items()}
            for r in each_row(batches):
                at, h, f, doc, known = (spread_out(r[c], t) for c, t in (("at", np.int64), ("h", np.uint64), ("f", np.uint64), ("doc", np.int64), ("known", bool)))
                gone = at[_gone(shards, n_shards, h, f, doc, known, min_docs)]
                if len(gone):
                    yield pa.RecordBatch.from_arrays([pa.array([r["chunk"]], pa.int64()), pa.array([squeeze(gone)], pa.binary())], ["chunk", "gone"])

        # a repeated attempt of a pass replaces its own folder
        asked.filter(F.col("part") == g).mapInArrow(probe, "chunk long, gone binary").write.mode("overwrite").parquet(f"{told}/pass={g}")
        held.destroy()
    told = spark.read.schema("chunk long, gone binary").parquet(*[f"{told}/pass={g}" for g in range(len(groups))])

    def rewrite(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_text"])
        ids, texts = unpack_rows(left.column("data")[0].as_py())
        own = lines(texts, min_chars)
        gone = np.concatenate([np.zeros(0, np.int64), *(spread_out(x, np.int64) for x in right.column("gone").to_pylist())])
        return pa.Table.from_batches([_rewrite(pa.array(ids, pa.int64()), own, gone)])

    return chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(rewrite, RESULT)

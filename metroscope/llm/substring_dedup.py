"""Substring deduplication with a count-min prefilter and exact grouping.

A window is ``k`` consecutive white-space words of one document.  A word is
removed when a window that covers it also starts in a document with a smaller
doc_id; windows are judged on the input.

1. Sketch.  Every chunk of documents counts its windows in a count-min sketch
   of ``DEPTH`` rows.  Only the cells it touches travel, cut into column ranges;
   each range is merged by one task, which keeps one bit per cell: counted at
   least twice.  The merged bits (at most ``SKETCH_BYTES``, whatever the input)
   are broadcast.  A sketch never underestimates, so no repeated window is lost;
   a fuller sketch only lets more windows through.
2. Exact groups.  Windows whose bits are set in every row go, once per chunk,
   with a 96-bit hash and the chunk's smallest doc_id to the task of their hash
   slice, which finds the smallest doc_id of all and answers one bit: a smaller
   one exists elsewhere.  A window that a third of all documents share is one
   entry per chunk.
3. Removal.  Each chunk marks its covered words and joins the others.

Defined cases: a null text has no words; a document shorter than a window
keeps all; rows that repeat a doc_id are one document to each other (their
shared windows stay); a null doc_id is the smallest; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.llm.runtime import chunk_table, each_row, parts_for, slice_bounds, spread_out, squeeze, unpack_rows
from metroscope.llm.words import inside_text, split, windows

WINDOW = 50
DEPTH = 2
SKETCH_BYTES = 64 << 20
NO_ID = -(1 << 63)
_ROW = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    """Cell of each window hash in one sketch row of ``2**bits`` cells."""
    return ((h * _ROW[row]) >> np.uint64(64 - bits)).astype(np.uint32)


def _window_hashes(texts: pa.StringArray, k: int):
    """Words, positions of windows, and their 64-bit hashes."""
    w = split(texts, "space")
    h = w.hashes()
    at = inside_text(w, k)
    return w, h, at, windows(h, k, 1)[at] if len(at) else np.zeros(0, np.uint64)


def build_sketch(chunks: DataFrame, k: int, max_bytes: int = SKETCH_BYTES) -> tuple[int, np.ndarray]:
    """(bits, rows of packed bits): cells of the merged sketch that were counted at least twice."""
    size = chunks.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    # about eight cells per window (a chunk's byte is roughly a third of a word), within the bound
    bits = min(max(16, int(8 * size / 3).bit_length()), (max_bytes * 8 // DEPTH).bit_length() - 1)
    span = min(bits, 22)  # columns of a range
    ranges = 1 << (bits - span)

    def touch(batches: Iterator[pa.RecordBatch]):
        for r in each_row(batches):
            _, _, _, h = _window_hashes(unpack_rows(r["data"])[1], k)
            out = []
            for row in range(DEPTH):
                cell, count = np.unique(_cells(h, row, bits), return_counts=True)
                cut = np.searchsorted(cell >> np.uint32(span), np.arange(ranges + 1))
                for i in range(ranges):
                    own, n = cell[cut[i]:cut[i + 1]] & np.uint32((1 << span) - 1), count[cut[i]:cut[i + 1]]
                    if len(own):
                        # ascending cells as gaps; cells counted twice or more are sent twice
                        own = np.repeat(own, np.minimum(n, 2))
                        out.append((row * ranges + i, squeeze(np.diff(own, prepend=0).astype(np.uint32).view(np.uint8).reshape(-1, 4).T)))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], ["part", "cells"])

    def merge(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << span, np.uint8)
        for r in each_row(batches):
            cells = np.cumsum(spread_out(r["cells"], np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel())
            own, n = np.unique(cells, return_counts=True)
            total[own] = np.minimum(total[own] + n, 2)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(total >= 2).tobytes()], pa.binary())], ["part", "bits"])

    merged = chunks.mapInArrow(touch, "part int, cells binary").groupBy("part").applyInArrow(merge, "part int, bits binary")
    sketch = np.zeros((DEPTH, 1 << max(0, bits - 3)), np.uint8)
    for r in merged.toLocalIterator():  # one range at a time; together at most max_bytes
        row, i = divmod(r["part"], ranges)
        piece = np.frombuffer(r["bits"], np.uint8)
        sketch[row, i * len(piece):(i + 1) * len(piece)] = piece
    return bits, sketch


def _repeated(h: np.ndarray, bits: int, sketch: np.ndarray) -> np.ndarray:
    """Whether each window is estimated to occur at least twice."""
    out = np.ones(len(h), bool)
    for row in range(DEPTH):
        cell = _cells(h, row, bits)
        out &= (sketch[row][cell >> np.uint32(3)] >> (np.uint32(7) - (cell & np.uint32(7))).astype(np.uint8)) & 1 == 1
    return out


def candidates(doc_ids: list, texts: pa.StringArray, k: int, bits: int, sketch: np.ndarray) -> dict:
    """Windows of a chunk that the sketch lets through, grouped into distinct entries in hash order."""
    w, words, at, h = _window_hashes(texts, k)
    hit = _repeated(h, bits, sketch)
    at, high = at[hit], h[hit]
    low = (windows(words, k, 2)[at] >> np.uint64(32)).astype(np.uint32) if len(at) else np.zeros(0, np.uint32)
    ids = np.array([NO_ID if d is None else d for d in doc_ids], np.int64)
    doc = ids[np.searchsorted(w.first, at, side="right") - 1] if len(at) else np.zeros(0, np.int64)
    order = np.lexsort((low, high))
    new = np.ones(len(order), bool)
    new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
    first = np.flatnonzero(new)
    entry = np.empty(len(order), np.int64)
    entry[order] = np.cumsum(new) - 1
    smallest = np.minimum.reduceat(doc[order], first) if len(first) else np.zeros(0, np.int64)
    return {"words": w, "at": at, "doc": doc, "entry": entry, "high": high[order][first], "low": low[order][first], "smallest": smallest}


def remove_repeats(docs: DataFrame, k: int = WINDOW, max_sketch: int = SKETCH_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text (kept words joined by one space)."""
    spark = docs.sparkSession
    chunks = chunk_table(docs, "substring-chunks")
    bits, sketch = build_sketch(chunks, k, max_sketch)
    held = spark.sparkContext.broadcast(sketch)
    n_slices = parts_for(chunks, 4 << 20)

    def ask(batches: Iterator[pa.RecordBatch]):
        for r in each_row(batches):
            c = candidates(*unpack_rows(r["data"]), k, bits, held.value)
            cut = slice_bounds(c["high"], n_slices)
            rows = [(i, r["chunk"], c["high"][cut[i]:cut[i + 1]].tobytes(), c["low"][cut[i]:cut[i + 1]].tobytes(),
                     squeeze(c["smallest"][cut[i]:cut[i + 1]])) for i in np.flatnonzero(np.diff(cut)).tolist()]
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))],
                                             ["slice", "chunk", "high", "low", "doc"])

    def answer(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = list(each_row(batches))
        high = np.concatenate([np.frombuffer(r["high"], np.uint64) for r in rows])
        low = np.concatenate([np.frombuffer(r["low"], np.uint32) for r in rows])
        doc = np.concatenate([spread_out(r["doc"], np.int64) for r in rows])
        order = np.lexsort((low, high))
        new = np.ones(len(order), bool)
        new[1:] = (high[order][1:] != high[order][:-1]) | (low[order][1:] != low[order][:-1])
        first = np.flatnonzero(new)
        least = np.empty(len(order), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.append(first, len(order))))
        smaller = least < doc
        ends = np.cumsum([len(r["high"]) // 8 for r in rows])
        flags = [np.packbits(x).tobytes() for x in np.split(smaller, ends[:-1])]
        yield pa.RecordBatch.from_arrays([pa.array([r["chunk"] for r in rows], pa.int64()), pa.array([key[0].as_py()] * len(rows), pa.int32()),
                                          pa.array(np.diff(ends, prepend=0), pa.int32()), pa.array(flags, pa.binary())],
                                         ["chunk", "slice", "n", "flags"])

    replies = (chunks.mapInArrow(ask, "slice int, chunk long, high binary, low binary, doc binary")
               .groupBy("slice").applyInArrow(answer, "chunk long, slice int, n int, flags binary"))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        names, types = ["doc_id", "n_words", "n_removed", "kept_text"], [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        if not left.num_rows:
            return pa.table([pa.array([], t) for t in types], names)
        doc_ids, texts = unpack_rows(left.column("data")[0].as_py())
        texts = pc.binary_join_element_wise(texts, "", "\n")  # a separator after every last word
        c = candidates(doc_ids, texts, k, bits, held.value)
        answers = sorted(zip(*(right.column(x).to_pylist() for x in ("slice", "n", "flags"))))
        elsewhere = np.concatenate([np.zeros(0, bool), *(np.unpackbits(np.frombuffer(f, np.uint8), count=n).astype(bool) for _, n, f in answers)])
        w, entry = c["words"], c["entry"]
        gone = c["at"][elsewhere[entry] | (c["doc"] > c["smallest"][entry])]
        cover = np.zeros(len(w) + 1, np.int64)
        np.add.at(cover, gone, 1)
        np.add.at(cover, gone + k, -1)
        kept = np.cumsum(cover[:-1]) == 0
        # the bytes of kept words, each with the separator after it as a space
        edge = np.zeros(len(w.buf) + 2, np.int8)
        edge[w.start[kept]] += 1
        edge[w.end[kept] + 1] -= 1
        inside = np.cumsum(edge[:len(w.buf)], dtype=np.int8) > 0
        buf = w.buf.copy()
        buf[w.end[kept]] = 0x20
        out = buf[inside].tobytes()
        total = np.concatenate([[0], np.cumsum((w.end - w.start + 1) * kept)])[w.first]
        kept_text = [out[a:b - 1 if b > a else b].decode() for a, b in zip(total[:-1].tolist(), total[1:].tolist())]
        removed = np.concatenate([[0], np.cumsum(~kept)])[w.first]
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(w.counts, pa.int64()), pa.array(np.diff(removed), pa.int64()), pa.array(kept_text, pa.string())], names)

    return (chunks.groupBy("chunk").cogroup(replies.groupBy("chunk"))
            .applyInArrow(remove, "doc_id long, n_words long, n_removed long, kept_text string"))

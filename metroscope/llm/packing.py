"""Hierarchical multi-length packing of tokenised documents.

Context-size tiers are powers of two up to the longest window.  A document's
whole windows of the longest size become sequences of their own; what remains
is routed to the smallest tier that holds it.  When enough documents wait in a
tier, its windows are packed: the longest waiting piece first, then the largest
waiting pieces of the same or shorter tiers that fit (the gaps of long windows
are filled from shorter tiers), and a last gap by cutting one waiting piece.
Every window is therefore full.  At the end of a task the few waiting pieces
are closed with windows of falling powers of two, so nothing is padded.
Finished windows of one tier are dealt to training steps of equal token
counts, heaviest first and back and forth, so that the attention cost (sum of
squared piece lengths) of neighbouring steps is alike.

Packing runs inside the scan's own tasks: no shuffle, no state beyond one
task, bounded waiting lists.  A sequence id holds the task number, so ids are
unique and a rerun task yields the same rows for the same input.

Defined cases: a null or empty text has the end id only; repeated rows are
separate documents; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from metroscope.llm.runtime import blocks, doc_text, string_column
from metroscope.llm.tokens import Encoder

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "tier long, step_id long")
LONGEST = 2048
SHORTEST = 128
WAITING = 128          # pieces a tier holds before it is packed
STEP_TOKENS = 1 << 16  # tokens of one training step
STEPS = 4              # steps of one tier that are balanced against each other


@dataclass(order=True)
class Piece:
    length: int
    doc: int = field(compare=False)      # doc_id, or None
    start: int = field(compare=False)
    total: int = field(compare=False)
    ids: np.ndarray = field(compare=False)

    def cut(self, n: int) -> tuple["Piece", "Piece"]:
        return (Piece(n, self.doc, self.start, self.total, self.ids[:n]),
                Piece(self.length - n, self.doc, self.start + n, self.total, self.ids[n:]))


class Packer:
    """Packs the documents of one task; ``emit`` receives (window size, pieces)."""

    def __init__(self, emit, longest: int = LONGEST, shortest: int = SHORTEST, waiting: int = WAITING):
        self.emit, self.longest, self.waiting = emit, longest, waiting
        self.tiers = [1 << k for k in range(shortest.bit_length() - 1, longest.bit_length())]
        self.pool: dict[int, list[Piece]] = {t: [] for t in self.tiers}  # sorted by length

    def _wait(self, piece: Piece) -> int:
        tier = self.tiers[bisect.bisect_left(self.tiers, piece.length)]
        bisect.insort(self.pool[tier], piece)
        return tier

    def add(self, doc, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.longest
        for s in range(0, whole, self.longest):
            self.emit(self.longest, [Piece(self.longest, doc, s, n, ids[s:s + self.longest])])
        if n > whole:
            tier = self._wait(Piece(n - whole, doc, whole, n, ids[whole:].copy()))
            if len(self.pool[tier]) >= self.waiting:
                self.pack(tier)

    def _fitting(self, tier: int, gap: int) -> Piece | None:
        """The longest waiting piece of this tier or a shorter one that fits the gap."""
        for t in reversed(self.tiers[:self.tiers.index(tier) + 1]):
            i = bisect.bisect_right(self.pool[t], gap, key=lambda p: p.length)
            if i:
                return self.pool[t].pop(i - 1)
        return None

    def pack(self, tier: int) -> None:
        """Fill windows of one tier until half of its pieces are gone."""
        pool = self.pool[tier]
        while len(pool) > self.waiting // 2:
            window = [pool.pop()]
            gap = tier - window[0].length
            while gap:
                piece = self._fitting(tier, gap)
                if piece is None:  # all that wait are longer than the gap: cut the shortest
                    source = next(t for t in self.tiers if self.pool[t])
                    piece, rest = self.pool[source].pop(0).cut(gap)
                    self._wait(rest)
                window.append(piece)
                gap -= piece.length
            self.emit(tier, window)

    def close(self) -> None:
        """Put the waiting pieces, longest first, into windows of falling powers of two."""
        left = sorted((p for pool in self.pool.values() for p in pool), reverse=True)
        total = sum(p.length for p in left)
        left.reverse()
        while total:
            size = min(self.longest, 1 << (total.bit_length() - 1))
            window, gap = [], size
            while gap:
                piece = left.pop()
                if piece.length > gap:
                    piece, rest = piece.cut(gap)
                    left.append(rest)
                window.append(piece)
                gap -= piece.length
            self.emit(size, window)
            total -= size


def _windows(batches: Iterator[pa.RecordBatch], tokenizer: str, end_id: int, added: bool) -> Iterator[list]:
    """Packed windows of a task, as they are finished."""
    encoder, done = Encoder(tokenizer, added), []
    packer = Packer(lambda size, pieces: done.append((size, pieces)))
    for batch in blocks(batches):
        ids, off = encoder.encode(string_column(batch, "text"), end_id)
        for i, doc in enumerate(batch.column("doc_id").to_pylist()):
            packer.add(doc, ids[off[i]:off[i + 1]])
        yield done
        done.clear()
    packer.close()
    yield done


def _steps(group: list, tier: int) -> list[list]:
    """Deal windows to steps of STEP_TOKENS, heaviest first, back and forth."""
    n = max(1, -(-len(group) * tier // STEP_TOKENS))
    group.sort(key=lambda w: -sum(p.length ** 2 for p in w))
    out = [[] for _ in range(n)]
    for i, w in enumerate(group):
        turn, k = divmod(i, n)
        out[n - 1 - k if turn % 2 else k].append(w)
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, with_ids: bool = False, added: bool = False) -> DataFrame:
    """Pieces of all documents with their place in the packed sequences.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, tier (window size), step_id; with ``with_ids`` also
    ``ids`` (little-endian unsigned 32-bit, binary), the training data itself.
    """
    schema = SCHEMA + (", ids binary" if with_ids else "")

    def run(batches):
        task, count = TaskContext.get().partitionId(), {"seq": 0, "step": 0}
        ready: dict[int, list] = {}
        types = [pa.int64()] * 9 + ([pa.binary()] if with_ids else [])
        names = [c.split()[0] for c in schema.split(", ")]

        def rows(steps, tier):
            cols = [[] for _ in names]
            for step in steps:
                step_id = task << 32 | count["step"]
                count["step"] += 1
                for window in step:
                    offset = 0
                    for p in window:
                        raw = p.ids.astype("<u4").tobytes()
                        for c, v in zip(cols, (p.doc, p.start, p.length, zlib.crc32(raw), p.total,
                                               task << 40 | count["seq"], offset, tier, step_id, raw)):
                            c.append(v)
                        offset += p.length
                    count["seq"] += 1
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

        for done in _windows(batches, tokenizer, end_id, added):
            for size, window in done:
                group = ready.setdefault(size, [])
                group.append([Piece(p.length, p.doc, p.start, p.total, p.ids.copy()) for p in window])
                if len(group) * size >= STEPS * STEP_TOKENS:
                    yield rows(_steps(group, size), size)
                    ready[size] = []
        for size, group in sorted(ready.items()):
            if group:
                yield rows(_steps(group, size), size)

    return doc_text(docs).mapInArrow(run, schema)

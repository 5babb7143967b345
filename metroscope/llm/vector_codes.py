"""Vector codes by dual-tree Lloyd iterations (product quantisation in integers).

Vectors become integers (``floor(256 x)``) and are cut into equal parts; every
part position has a codebook.  Vectors are stored once, in blocks; a block
carries a balanced tree over its parts at each position (halved along the
widest side, the order of the leaves is what is stored).  A round builds a
tree over each codebook's entries too and walks both together, level by
level, for all positions at once:

* a pair (node of parts, node of entries) is dropped when its least possible
  distance exceeds the smallest of the greatest distances the node's pairs
  allow; all bounds are integers, so a tie is never dropped;
* a node of parts left with one entry is assigned whole: its cached sum and
  count go to the entry, no part is read;
* what is still open at the leaves is decided by integer distances.

Only one sum and one count per entry leave a task; they are added up by Spark
and the next codebooks (positions x entries, whatever the table's size) are
sent out.  A lost executor re-reads the stored blocks.

Defined cases: a null vector, or one with a null or non-finite component, is
dropped; so is an empty one, and one whose length differs from the most frequent length of
the others (of equally frequent ones the longest).  The length must be a
multiple of the number of parts.  The first codebooks come from the smallest
vec_ids, nulls last and equal ids by vector; fewer vectors give fewer entries.
Repeated rows count as often as they occur.  Components are at most about
2**18 in size for four-dimensional parts (the message of the error names the
bound); beyond it squared distances would leave 64 bits and the job fails
instead of returning wrong codes.  Other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.llm.runtime import each_row, spread_out, squeeze, stored
from metroscope.operators.common import broadcast_if_small

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
LEAF = 8                # parts of a leaf, about
BLOCK_ROWS, BLOCK_BYTES = 1 << 14, 32 << 20
PAIRS_AT_ONCE = 1 << 20  # part-entry distances computed at a time at the leaves
_NONE = np.iinfo(np.int64).max
BLOCKS = "ids array<long>, labels array<string>, points binary, order binary"


def depth_for(n: int, leaf: int) -> int:
    """Levels below the root of a balanced tree whose leaves hold about ``leaf`` items, none empty."""
    return max(0, int(n // max(1, leaf)).bit_length() - 1) if n else 0


def bounds(n: int, level: int) -> np.ndarray:
    """First item of each node of a level, and the end; nodes of the next level halve them."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def tree_order(points: np.ndarray, depth: int) -> np.ndarray:
    """Order of the items (positions x n) in which every node of a balanced tree is a run."""
    parts, n, _ = points.shape
    order = np.tile(np.arange(n, dtype=np.int64), (parts, 1))
    for level in range(depth):
        at = bounds(n, level)
        own = np.take_along_axis(points, order[:, :, None], 1)
        side = np.argmax(np.maximum.reduceat(own, at[:-1], 1) - np.minimum.reduceat(own, at[:-1], 1), axis=2)
        node = np.repeat(np.arange(len(at) - 1), np.diff(at))
        value = np.take_along_axis(own, side[:, node][:, :, None], 2)[:, :, 0]
        low = value.min()
        key = node * (int(value.max()) - int(low) + 1) + (value - low)
        order = np.take_along_axis(order, np.argsort(key, axis=1, kind="stable"), 1)
    return order


class Tree:
    """Boxes, sums and counts of the nodes over items in tree order (positions x n x width)."""

    def __init__(self, points: np.ndarray, depth: int):
        self.points, self.depth = points, depth
        parts, n, width = points.shape
        self.at = bounds(n, depth)
        low = [np.minimum.reduceat(points, self.at[:-1], 1)]
        high = [np.maximum.reduceat(points, self.at[:-1], 1)]
        total = [np.add.reduceat(points, self.at[:-1], 1)]
        for _ in range(depth):  # a node's box and sum come from its two halves
            low.append(np.minimum(low[-1][:, ::2], low[-1][:, 1::2]))
            high.append(np.maximum(high[-1][:, ::2], high[-1][:, 1::2]))
            total.append(total[-1][:, ::2] + total[-1][:, 1::2])
        self.low, self.high, self.total = low[::-1], high[::-1], total[::-1]


class EntryTree(Tree):
    """Tree over a codebook's entries with one entry in each leaf; ``index`` names them.

    Up to a power of two the last entry is repeated: of equal entries the
    lower index wins, so repeats never do.
    """

    def __init__(self, codebooks: np.ndarray):
        n = codebooks.shape[1]
        depth = max(0, (n - 1).bit_length())
        padded = np.concatenate([codebooks, np.repeat(codebooks[:, -1:], (1 << depth) - n, 1)], 1)
        self.index = tree_order(padded, depth)
        super().__init__(np.take_along_axis(padded, self.index[:, :, None], 1), depth)


@dataclass
class Assigned:
    """What a walk found: sums and counts per position and entry, entry of each part (original order) if asked for."""
    sums: np.ndarray
    counts: np.ndarray
    codes: np.ndarray | None
    whole: int      # parts assigned with their node
    compared: int   # part-entry distances computed


def assign(tree: Tree, order: np.ndarray, codebooks: np.ndarray, codes: bool = False) -> Assigned:
    """Nearest entry of every part by walking the tree of parts and the tree of entries together."""
    parts, n, width = tree.points.shape
    size = codebooks.shape[1]
    entries = EntryTree(codebooks)
    sums, counts = np.zeros((parts, entries.points.shape[1], width), np.int64), np.zeros((parts, entries.points.shape[1]), np.int64)
    found = np.zeros((parts, n), np.int64) if codes else None
    whole = compared = 0
    pos, node, entry = np.arange(parts), np.zeros(parts, np.int64), np.zeros(parts, np.int64)
    level, depth = 0, 0
    while len(pos):
        low, high = tree.low[level][pos, node], tree.high[level][pos, node]
        near, far = entries.low[depth][pos, entry], entries.high[depth][pos, entry]
        gap = np.maximum(np.maximum(near - high, low - far), 0)
        reach = np.maximum(high - near, far - low)
        least, most = (gap * gap).sum(1), (reach * reach).sum(1)
        key = pos * (1 << level) + node  # pairs are sorted by it
        first = np.flatnonzero(np.diff(key, prepend=-1))
        run = np.diff(np.append(first, len(key)))
        keep = least <= np.repeat(np.minimum.reduceat(most, first), run)
        pos, node, entry, key = pos[keep], node[keep], entry[keep], key[keep]
        if depth == entries.depth:
            first = np.flatnonzero(np.diff(key, prepend=-1))
            run = np.diff(np.append(first, len(key)))
            alone = first[run == 1]
            p, v, e = pos[alone], node[alone], entries.index[pos[alone], entry[alone]]
            at = bounds(n, level)
            many = at[v + 1] - at[v]
            np.add.at(sums, (p, e), tree.total[level][p, v])
            np.add.at(counts, (p, e), many)
            whole += int(many.sum())
            if codes:
                line, spot = np.repeat(p, many), _runs(at[v], many)
                found[line, order[line, spot]] = np.repeat(e, many)
            rest = np.repeat(run > 1, run)
            pos, node, entry = pos[rest], node[rest], entry[rest]
            if level == tree.depth:
                compared += _leaves(tree, order, entries, pos, node, entry, sums, counts, found)
                break
        down, across = level < tree.depth, depth < entries.depth
        if down:
            pos, node, entry = np.repeat(pos, 2), np.repeat(node * 2, 2), np.repeat(entry, 2)
            node[1::2] += 1
        if across:
            pos, node, entry = np.repeat(pos, 2), np.repeat(node, 2), np.repeat(entry * 2, 2)
            entry[1::2] += 1
        level, depth = level + down, depth + across
        by = np.argsort(pos * (1 << level) + node, kind="stable")
        pos, node, entry = pos[by], node[by], entry[by]
    # repeats of the last entry never win a tie, so nothing lies beyond the codebook
    return Assigned(sums[:, :size], counts[:, :size], found, whole, compared)


def _runs(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... for each run, one after the other."""
    return np.repeat(start - np.cumsum(length) + length, length) + np.arange(int(length.sum()))


def _leaves(tree: Tree, order, entries: EntryTree, pos, node, entry, sums, counts, found) -> int:
    """Decide the parts of open leaves by integer distances; ties go to the lower entry."""
    if not len(pos):
        return 0
    parts, n, _ = tree.points.shape
    many = tree.at[node + 1] - tree.at[node]
    key = pos * (1 << tree.depth) + node
    first = np.flatnonzero(np.diff(key, prepend=-1))  # pairs of a leaf stay together
    cost = np.add.reduceat(many, first)
    cut = np.searchsorted(np.cumsum(cost), np.arange(PAIRS_AT_ONCE, int(cost.sum()) + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
    edges = np.unique(np.append(np.append(first, len(key))[np.minimum(cut + 1, len(first))], [0, len(key)]))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        m = many[a:b]
        p, spot = np.repeat(pos[a:b], m), _runs(tree.at[node[a:b]], m)
        e = np.repeat(entry[a:b], m)
        away = tree.points[p, spot] - entries.points[p, e]
        # distance and index in one number: the smallest is the nearest entry of lowest index
        score = (away * away).sum(1) * entries.index.shape[1] + entries.index[p, e]
        best = np.full(parts * n, _NONE)
        np.minimum.at(best, p * n + spot, score)
        own = np.flatnonzero(best < _NONE)
        p, spot, e = own // n, own % n, best[own] % entries.index.shape[1]
        np.add.at(sums, (p, e), tree.points[p, spot])
        np.add.at(counts, (p, e), 1)
        if found is not None:
            found[p, order[p, spot]] = e
    return int(many.sum())


# ------------------------------------------------------------------ Spark side
def largest(width: int, entries: int) -> int:
    """Largest integer component for which squared part distances, with the entry's index, stay within 64 bits."""
    return isqrt((1 << 62) // (max(1, width) * (1 << max(0, (entries - 1).bit_length())))) // 2


def usable(table: DataFrame) -> DataFrame:
    """vec_id, label (as text) and vector of the rows with a finite vector of the most frequent length."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                        F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.filter((F.size("vector") > 0) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.filter(F.size("vector") == (lengths["n"] if lengths else 0))


def integers(vectors: pa.Array, n: int) -> np.ndarray:
    """Rows of floor(SCALE * x)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    return np.floor(flat * SCALE).reshape(n, len(flat) // n if n else 0)


def _checked(values: np.ndarray, parts: int, entries: int) -> np.ndarray:
    if values.shape[1] % parts:
        raise ValueError(f"vectors of {values.shape[1]} components cannot be cut into {parts} equal parts")
    most = largest(values.shape[1] // parts, entries)
    if values.size and np.abs(values).max() > most:
        raise ValueError(f"a component beyond {most / SCALE:g} would leave 64-bit distances")
    return values.astype(np.int64)


def _parts(values: np.ndarray, parts: int) -> np.ndarray:
    """positions x rows x width"""
    n, d = values.shape
    return np.ascontiguousarray(values.reshape(n, parts, d // parts).transpose(1, 0, 2))


def tree_blocks(rows: DataFrame, parts: int, entries: int, name: str = "vector-trees") -> DataFrame:
    """The usable rows in blocks with the order of their trees, stored once."""
    def build(batches: Iterator[pa.RecordBatch]):
        ids, labels, held, size = [], [], [], 0

        def block():
            values = np.concatenate(held)
            points = _parts(values, parts)
            order = tree_order(points, depth_for(len(values), LEAF))
            cols = [ids, labels, squeeze(values.astype(np.int32)), squeeze(order.astype(np.int32))]
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(cols, (pa.list_(pa.int64()), pa.list_(pa.string()), pa.binary(), pa.binary()))],
                                              ["ids", "labels", "points", "order"])

        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                b = whole.slice(at, 1024)
                values = _checked(integers(b.column("vector"), b.num_rows), parts, entries)
                if held and (len(ids) + len(values) > BLOCK_ROWS or size + values.nbytes > BLOCK_BYTES):
                    yield block()
                    ids, labels, held, size = [], [], [], 0
                ids += b.column("vec_id").to_pylist()
                labels += b.column("label").to_pylist()
                held.append(values)
                size += values.nbytes
        if held:
            yield block()

    return stored(rows.mapInArrow(build, BLOCKS), name)


def _load(row: dict, parts: int) -> tuple[np.ndarray, np.ndarray, Tree]:
    """Values, order and tree of a stored block."""
    n = len(row["ids"])
    values = spread_out(row["points"], np.int32).reshape(n, -1).astype(np.int64)
    order = spread_out(row["order"], np.int32).reshape(parts, n).astype(np.int64)
    points = np.take_along_axis(_parts(values, parts), order[:, :, None], 1)
    return values, order, Tree(points, depth_for(n, LEAF))


class VectorCodes:
    """Codebooks fitted on all usable rows of ``table`` and the codes of these rows.

    ``codebooks`` is an integer array positions x entries x width.
    """

    def __init__(self, table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS):
        self.parts, self.spark = parts, table.sparkSession
        rows = usable(table)
        # a bounded number of rows: the first codebooks
        first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
        values = np.array([np.floor(np.array(r["vector"], np.float64) * SCALE) for r in first]).reshape(len(first), len(first[0]["vector"]) if first else 0)
        self.codebooks = _parts(_checked(values, parts, entries), parts)
        self.blocks = tree_blocks(rows, parts, entries)
        for _ in range(rounds if len(first) else 0):
            self.codebooks = self._next()

    def _next(self) -> np.ndarray:
        """One Lloyd round: componentwise floor of sum over count; an unused entry stays."""
        parts, held = self.parts, self.spark.sparkContext.broadcast(self.codebooks)

        def run(batches: Iterator[pa.RecordBatch]):
            sums = counts = 0
            for r in each_row(batches):
                values, order, tree = _load(r, parts)
                got = assign(tree, order, held.value)
                sums, counts = sums + got.sums, counts + got.counts
            if isinstance(sums, np.ndarray):
                p, e = np.nonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]),
                                                  pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

        each = self.blocks.mapInArrow(run, "part int, entry int, n long, sums array<long>")
        width = self.codebooks.shape[2]
        totals = each.groupBy("part", "entry").agg(
            F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(width)]).alias("sums")).collect()
        out = self.codebooks.copy()
        for r in totals:  # at most parts x entries rows
            out[r["part"], r["entry"]] = [int(s) // r["n"] for s in r["sums"]]
        held.unpersist()
        return out

    def digest(self) -> str:
        """SHA-256 of all components by position, entry and place, comma-joined."""
        return hashlib.sha256(",".join(map(str, self.codebooks.ravel().tolist())).encode()).hexdigest()

    def codes(self) -> DataFrame:
        """vec_id, label (as text), code (two hex digits a part), error (squared distances summed over parts)."""
        if self.codebooks.shape[1] > 256:
            raise ValueError("two hex digits name at most 256 entries")
        parts, held = self.parts, self.spark.sparkContext.broadcast(self.codebooks)

        def run(batches: Iterator[pa.RecordBatch]):
            for r in each_row(batches):
                values, order, tree = _load(r, parts)
                code = assign(tree, order, held.value, codes=True).codes
                away = _parts(values, parts) - held.value[np.arange(parts)[:, None], code]
                text = code.T.astype(np.uint8).tobytes().hex()
                hexes = [text[i:i + 2 * parts] for i in range(0, len(text), 2 * parts)]
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["labels"], pa.string()), pa.array(hexes, pa.string()),
                                                  pa.array((away * away).sum((0, 2)))], ["vec_id", "label", "code", "error"])

        return self.blocks.mapInArrow(run, "vec_id long, label string, code string, error long")


def report(found: VectorCodes) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256."""
    codes = stored(found.codes(), "vector-codes")
    totals = codes.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).cast("long").alias("label_error"))
    # few labels are broadcast after a count; with more the join is split by adaptive execution where a label is hot
    totals = broadcast_if_small(totals.withColumnRenamed("label", "of"))
    return (codes.join(totals, F.col("label").eqNullSafe(F.col("of")))
            .select("vec_id", "code", "error", "label_error", F.lit(found.digest()).alias("codebooks_sha256")))

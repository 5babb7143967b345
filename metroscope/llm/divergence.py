"""Divergence of sources by their terms, with strings fetched last.

Terms are runs of letters and non-ASCII bytes, A-Z lower-cased.  Each language
keeps the terms of at least ``MIN_DOCS`` of its documents.  A group (language
and source) gives every kept term the integer share
``p = 1 + floor(10**9 (count + 1) / (N + V))``; groups are compared with one
another and with their language by ``floor((p - q)**2 / q)`` in integers.

Late strings.  Every task reduces its documents to one row for each language
and 64-bit term digest it met: documents, the term's string, and occurrences by
source as packed numbers.  The rows are shuffled once, by digest, and sorted in
their tasks, where those of a term are added up; terms in too few documents end
there.  Fixed-width rows are compared and ranked from then on.

* Collisions: the strings of a kept digest are reduced to minimum and maximum;
  where they differ, several terms share the digest.  Those digests alone are
  counted again with the term beside the digest, so they split exactly.  A term
  can only be kept under a kept digest, so nothing else needs the test.
* Text: ranks by value alone decide which digests can be reported (ties at the
  limit included); the string joins those rows only, then settles the ties.

Pairs of sources are the result itself, so they are summed as matrices: a row
per kept term holds its counts by source, a task adds up blocks of terms for
all pairs, Spark adds up the blocks.

Defined cases: null text, language or source counts as empty; a text without
letters has no terms, its group still appears; rows that repeat a doc_id are
documents of their own; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metroscope.llm.runtime import blocks, raw_text, stored, string_column
from metroscope.llm.words import split
from metroscope.operators.common import broadcast_if_small

MIN_DOCS, TOP = 3, 200
SCALE = 1_000_000_000
DIGEST_BITS = 64
HELD_ROWS = 1 << 20         # distinct (group, digest) rows a task holds before it writes them
MATRIX_CELLS = 1 << 21      # terms x sources of a block
SOURCES_AT_ONCE = 256       # rows of the pair matrix computed at a time
TOP_PARTS = 32              # parts of a group ranked apart before the group
MOST_SPLIT = 1 << 20        # colliding digests broadcast at most; 64 bits give fewer than one in a billion terms
MERGED_ROWS = 1 << 17       # sorted rows a task adds up at a time
PACKED = np.dtype([("grp", "<i4"), ("n", "<i8")])
PARTIAL = "lang int, digest long, name string, df long, packed binary"
KEPT = "lang int, digest long, name string, low string, high string, by_group array<struct<grp:int,n:long>>, lang_n long"
FAST_TOTAL = 90_000_000_000_000  # up to here shares are computed in 64 bits


def groups_of(docs: DataFrame) -> DataFrame:
    """Every occurring (lang, source), numbered: lang_no, and grp unique over all languages; stored once."""
    each = docs.groupBy(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).agg(F.lit(1).alias("one")).drop("one")
    # one row per group: the result has a row for each pair of them, so they are few
    return stored(each.withColumn("lang_no", F.dense_rank().over(Window.orderBy("lang")))
                  .withColumn("grp", F.row_number().over(Window.orderBy("lang", "source"))), "source-groups")


def numbered(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """lang_no, grp and text of every row."""
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
                      F.col("text").cast("string").alias("text"))
    return own.join(broadcast_if_small(groups), ["lang", "source"]).select("lang_no", "grp", "text")


def digest_bits(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).view(np.int64) if bits < 64 else h.view(np.int64)


def term_rows(docs: DataFrame, bits: int, only: np.ndarray | None = None) -> DataFrame:
    """One row of each task for every (language, digest) in its documents, with the string that has the digest.

    A digest with several strings has a further row without documents for its
    largest one.  With ``only`` (sorted digests) just their terms are counted, a row for each string.
    """
    spark = docs.sparkSession
    held = None if only is None else spark.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]):
        waiting, rows, terms = [], 0, {}
        for b in blocks(batches):
            found = _block(b, bits, None if held is None else held.value, terms)
            waiting.append(found)
            rows += len(found["n"])
            if rows > HELD_ROWS:
                waiting = [_merged(waiting)]
                rows = len(waiting[0]["n"])
                if rows > HELD_ROWS // 2:
                    yield _packed(waiting[0], terms)
                    waiting, rows, terms = [], 0, {}
        if waiting:
            yield _packed(_merged(waiting), terms)

    return docs.mapInArrow(run, PARTIAL)


def _block(b: pa.RecordBatch, bits: int, only: np.ndarray | None, terms: dict) -> dict:
    """Counts of a block's distinct (grp, digest, name); adds the block's strings to ``terms`` (digest -> smallest, largest)."""
    w = split(string_column(b, "text"), "letters")
    raw, digest, doc = w.buf.tobytes(), digest_bits(w.hashes(), bits), w.owner()
    start, end, name = w.start, w.end, None
    if only is not None:
        at = np.flatnonzero(np.isin(digest, only))
        digest, doc, start, end = digest[at], doc[at], start[at], end[at]
    if only is not None or bits < 64:  # strings behind equal digests may differ: go by the string
        strings = np.array([raw[s:e] for s, e in zip(start.tolist(), end.tolist())], object)
        kinds, term = np.unique(strings, return_inverse=True) if len(strings) else (strings, np.zeros(0, np.int64))
        of = np.zeros(len(kinds), np.int64)
        of[term] = digest
        name = kinds if only is not None else None
        for d, s in zip(of.tolist(), kinds.tolist()):
            low, high = terms.get(d, (s, s))
            terms[d] = (min(low, s), max(high, s))
        if name is None:
            of, term = np.unique(digest, return_inverse=True)
        at = np.arange(len(term))
    else:
        at = np.argsort(digest)  # words in the order of their digests
        of, first, term = _runs_of(digest[at])
        _note(terms, of, at[first], _put(term, at), w, raw)
    # words by (term, group, document) in one sort: documents are numbered group by group
    lang, grp = (b.column(c).to_numpy().astype(np.int64) for c in ("lang_no", "grp"))
    by_grp = np.argsort(grp, kind="stable")
    bit = max(1, len(grp).bit_length())
    key = term << bit | _put(np.arange(len(grp)), by_grp)[doc[at]]
    key.sort()
    term, place = key >> bit, key & ((1 << bit) - 1)
    owner = grp[by_grp][place]
    other_doc = np.ones(len(key), bool)  # a document counts once
    other_doc[1:] = key[1:] != key[:-1]
    new = other_doc.copy()
    new[1:] &= (term[1:] != term[:-1]) | (owner[1:] != owner[:-1])
    start = np.flatnonzero(new)
    term = term[start]
    return {"lang": lang[by_grp][place[start]], "grp": owner[start], "digest": of[term], "name": None if name is None else name[term],
            "n": np.diff(start, append=len(key)), "df": np.add.reduceat(other_doc.astype(np.int64), start) if len(start) else np.zeros(0, np.int64)}


def _runs_of(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values of a sorted array, where each begins, and the number of each element's value."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    return ordered[first], first, np.cumsum(new) - 1


def _put(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """``values[i]`` at position ``at[i]``."""
    out = np.empty(len(at), np.int64)
    out[at] = values
    return out


def _note(terms: dict, of: np.ndarray, first: np.ndarray, term: np.ndarray, w, raw: bytes) -> None:
    """Smallest and largest string of each digest of a block.

    Every occurrence is compared with the first one of its digest, byte length
    and bytes; only a digest with differing strings (none, but for a true
    collision) is looked at string by string.
    """
    other = _differ(w.buf, w.start, w.end, first[term])
    for d, s, e in zip(of.tolist(), w.start[first].tolist(), w.end[first].tolist()):
        s = raw[s:e]
        ends = terms.get(d)
        if ends is None:
            terms[d] = (s, s)
        elif ends[0] != s:
            terms[d] = (min(ends[0], s), max(ends[1], s))
    for i in np.flatnonzero(other).tolist():
        d, s = int(of[term[i]]), raw[w.start[i]:w.end[i]]
        low, high = terms[d]
        terms[d] = (min(low, s), max(high, s))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _differ(buf: np.ndarray, start: np.ndarray, end: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Whether each span of ``buf`` differs from the span numbered ``like``: lengths, then eight bytes at a time."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded.data, strides=(1,))
    length = end - start
    head = eight[start] & _MASK[np.minimum(length, 8)]
    other = (length != length[like]) | (head != head[like])
    at, step = np.flatnonzero(~other & (length > 8)), 8
    while len(at):
        mask = _MASK[np.minimum(length[at] - step, 8)]
        differs = ((eight[start[at] + step] ^ eight[start[like[at]] + step]) & mask) != 0
        other[at[differs]] = True
        step += 8
        at = at[~differs & (length[at] > step)]
    return other


def _merged(parts: list[dict]) -> dict:
    """Rows of several blocks with equal keys added up."""
    if len(parts) == 1:
        return parts[0]
    whole = {c: None if parts[0][c] is None else np.concatenate([p[c] for p in parts]) for c in parts[0]}
    if not len(whole["n"]):
        return whole
    keys = [whole["grp"], whole["digest"]]  # the last one leads
    if whole["name"] is not None:
        keys.insert(1, np.unique(whole["name"], return_inverse=True)[1])
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = reduce(np.logical_or, [k[order][1:] != k[order][:-1] for k in keys])
    first = np.flatnonzero(new)
    out = {c: None if whole[c] is None else whole[c][order][first] for c in ("lang", "grp", "digest", "name")}
    return out | {c: np.add.reduceat(whole[c][order], first) for c in ("n", "df")}


def _packed(rows: dict, terms: dict) -> pa.RecordBatch:
    """Rows by (lang, digest) of rows by (grp, digest) that come digest by digest; groups of a language are neighbours."""
    digest, lang, name = (rows[c] for c in ("digest", "lang", "name"))
    new = np.ones(len(digest), bool)
    new[1:] = (digest[1:] != digest[:-1]) | (lang[1:] != lang[:-1])
    if name is not None:
        new[1:] |= name[1:] != name[:-1]
    first = np.flatnonzero(new)
    items = np.empty(len(digest), PACKED)
    items["grp"], items["n"] = rows["grp"], rows["n"]
    lang, digest = lang[first], digest[first]
    df = np.add.reduceat(rows["df"], first) if len(first) else np.zeros(0, np.int64)
    ends = [] if name is not None else [terms[d] for d in digest.tolist()]
    names = name[first].tolist() if name is not None else [low for low, _ in ends]
    more = [i for i, (low, high) in enumerate(ends) if low != high]
    bounds = np.concatenate([first, np.full(1 + len(more), len(items))])
    packed = pa.Array.from_buffers(pa.binary(), len(first) + len(more), [None, pa.py_buffer((bounds * PACKED.itemsize).astype(np.int32)), pa.py_buffer(items.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([lang, lang[more]]).astype(np.int32)), pa.array(np.concatenate([digest, digest[more]])),
                                       pa.array(names + [ends[i][1] for i in more], pa.binary()).cast(pa.string()),
                                       pa.array(np.concatenate([df, np.zeros(len(more), np.int64)])), packed], ["lang", "digest", "name", "df", "packed"])


class SourceTerms:
    """Kept terms of all languages with their counts by group.

    ``counts``: lang, digest, name (null unless the digest is shared by several
    terms), by_group, lang_n.  ``strings``: the term of each kept digest that one term has, by language.
    """

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = DIGEST_BITS):
        self.groups = groups_of(docs)
        own = numbered(docs, self.groups)
        kept = _kept(term_rows(own, bits), min_docs)
        self.strings = kept.filter("low = high").select(F.col("lang").alias("lang_no"), "digest", F.col("low").alias("term"))
        counts = kept.drop("low", "high")
        shared = kept.filter("low != high").select("digest").distinct()
        n = shared.count()
        if n > MOST_SPLIT:
            raise ValueError(f"{n} colliding digests: use more digest bits")
        if n:
            only = np.sort(np.array([r["digest"] for r in shared.collect()], np.int64))  # at most MOST_SPLIT numbers
            again = _kept(term_rows(own, bits, only), min_docs, by_name=True).drop("low", "high")
            each = lambda df: df.join(F.broadcast(shared), "digest", "left_anti")
            self.strings = each(self.strings)
            counts = stored(each(counts).unionByName(again), "split-terms")
        self.counts, self.split = counts, n


def _kept(rows: DataFrame, min_docs: int, by_name: bool = False) -> DataFrame:
    """Counts by group of the terms in at least ``min_docs`` documents of their language, stored once.

    Rows meet by digest; a task gets them in order, so it holds a block of them, however many terms there are.
    """
    key = ["digest", "lang", "name"] if by_name else ["digest", "lang"]
    whole = rows.repartition("digest").sortWithinPartitions(*key).mapInArrow(lambda batches: _in_order(batches, key, min_docs), KEPT)
    return stored(whole, "kept-terms")


def _in_order(batches: Iterator[pa.RecordBatch], key: list[str], min_docs: int, at_once: int = MERGED_ROWS) -> Iterator[pa.RecordBatch]:
    """Sorted rows added up in blocks of about ``at_once``; the last term of a block waits for the next one."""
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= at_once:
            t = pa.Table.from_batches(held).combine_chunks()
            last = int(_changes(t, key)[-1])
            yield from _added_up(t.slice(0, last).combine_chunks(), key, min_docs)
            held = t.slice(last).combine_chunks().to_batches()
            n = n - last if last else 0  # one term of many rows: wait for as many again
    if held:
        yield from _added_up(pa.Table.from_batches(held).combine_chunks(), key, min_docs)


def _changes(t: pa.Table, key: list[str]) -> np.ndarray:
    """Where another key begins."""
    new = np.ones(t.num_rows, bool)
    new[1:] = reduce(np.logical_or, [c[1:] != c[:-1] for c in (t.column(k).to_numpy() for k in key)])
    return np.flatnonzero(new)


def _added_up(t: pa.Table, key: list[str], min_docs: int) -> Iterator[pa.RecordBatch]:
    start = _changes(t, key)
    if not len(start):
        return
    size = np.diff(start, append=t.num_rows)
    enough = np.add.reduceat(t.column("df").to_numpy(), start) >= min_docs
    if not enough.any():
        return
    t, size = t.filter(pa.array(np.repeat(enough, size))).combine_chunks(), size[enough]
    start, term = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
    data, off = raw_text(t.column("packed").chunk(0))
    items, count = data.view(PACKED), np.diff(off) // PACKED.itemsize
    owner, grp, n = np.repeat(term, count), items["grp"].astype(np.int64), items["n"]
    order = np.argsort(owner << 32 | grp)  # group numbers are 32-bit
    pair, first, _ = _runs_of((owner << 32 | grp)[order])
    sums, owner = np.add.reduceat(n[order], first), pair >> 32
    bounds = np.searchsorted(owner, np.arange(len(size) + 1))
    by_group = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(
        [pa.array((pair & 0xFFFFFFFF).astype(np.int32)), pa.array(sums)], ["grp", "n"]))
    names, none = t.column("name").chunk(0), pa.nulls(len(size), pa.string())
    low = high = names.take(pa.array(start))
    if "name" in key:
        name, low, high = low, none, none
    else:
        name = none
        buf, off = raw_text(names)
        other = _differ(buf, off[:-1], off[1:], start[term])
        if other.any():
            low, high = low.to_pylist(), high.to_pylist()
            for i in np.flatnonzero(other).tolist():
                k, s = int(term[i]), names[i].as_py()
                low[k], high[k] = min(low[k], s), max(high[k], s)
            low, high = pa.array(low, pa.string()), pa.array(high, pa.string())
    lang, digest = (t.column(c).to_numpy()[start] for c in ("lang", "digest"))
    yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(digest), name, low, high, by_group, pa.array(np.add.reduceat(sums, bounds[:-1]))],
                                     ["lang", "digest", "name", "low", "high", "by_group", "lang_n"])


# ------------------------------------------------------------------ integer shares
def share(count: Column, total: Column, distinct: Column) -> Column:
    """1 + floor(SCALE (count + 1) / (total + distinct)) of long columns: in two steps of 64 bits, beyond ``FAST_TOTAL`` in decimals."""
    of, one = total + distinct, F.lit(1).cast("long")
    div = lambda a, b: F.call_function("div", a, b)
    a = (count + one) * F.lit(100_000).cast("long")
    fast = one + div(a, of) * F.lit(10_000).cast("long") + div((a % of) * F.lit(10_000).cast("long"), of)
    exact = (count + one).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.when(of <= FAST_TOTAL, fast).otherwise((one + div(exact, of.cast("decimal(19,0)"))).cast("long"))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The same for arrays; ``total`` is N + V.  In two steps, so that products stay within 64 bits up to 9e13."""
    a, b = count + 1, np.maximum(total, 1)
    if int(np.max(b, initial=0)) > FAST_TOTAL:
        raise ValueError("more than 9e13 occurrences in a group")
    head, rest = np.divmod(a * 100_000, b)
    return 1 + head * 10_000 + rest * 10_000 // b


def distance(p, q):
    """floor((p - q)**2 / q); both are at most SCALE + 1, so the square fits 64 bits."""
    return (p - q) * (p - q) // q


def _totals(terms: SourceTerms) -> tuple[DataFrame, DataFrame]:
    """N of every group and, of every language, N and V; stored once."""
    langs = stored(terms.counts.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("distinct"))
                   .withColumnRenamed("lang", "lang_no"), "lang-totals")
    sums = terms.counts.select(F.explode("by_group").alias("g")).groupBy(F.col("g.grp").alias("grp")).agg(F.sum("g.n").alias("total"))
    groups = (terms.groups.join(sums, "grp", "left").join(langs, "lang_no", "left")
              .select("lang", "source", "lang_no", "grp", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "lang_total", "distinct")]))
    return stored(groups, "group-totals"), langs


def pair_values(terms: SourceTerms, groups: DataFrame) -> DataFrame:
    """lang, source, item, value for every ordered pair of sources of a language."""
    # numbers of each language's groups in order, with N + V: one row per language
    frame = groups.groupBy("lang_no").agg(F.sort_array(F.collect_list(F.struct("grp", (F.col("total") + F.col("distinct")).alias("nv")))).alias("all_groups"))
    rows = terms.counts.select(F.col("lang").alias("lang_no"), "by_group").join(broadcast_if_small(frame), "lang_no")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            langs = b.column("lang_no").to_numpy()
            for lang in np.unique(langs).tolist():
                at = np.flatnonzero(langs == lang)
                every = b.column("all_groups").take(pa.array(at[:1])).flatten()
                grp, total = (every.field(i).to_numpy().astype(np.int64) for i in (0, 1))
                step = max(1, MATRIX_CELLS // len(grp))
                sums = np.zeros((len(grp), len(grp)), np.int64) if len(grp) <= SOURCES_AT_ONCE else None
                for i in range(0, len(at), step):
                    own = b.column("by_group").take(pa.array(at[i:i + step]))
                    size = own.value_lengths().to_numpy()
                    flat = own.flatten()
                    count = np.zeros((len(size), len(grp)), np.int64)
                    count[np.repeat(np.arange(len(size)), size), np.searchsorted(grp, flat.field(0).to_numpy())] = flat.field(1).to_numpy()
                    q = np.ascontiguousarray(shares(count, total[None, :]).T)  # groups x terms
                    for s in range(0, len(grp), SOURCES_AT_ONCE):
                        found = np.stack([distance(q[j][None, :], q).sum(1) for j in range(s, min(len(grp), s + SOURCES_AT_ONCE))])
                        if sums is None:
                            yield _pairs(grp[s:s + SOURCES_AT_ONCE], grp, found)
                        else:
                            sums += found
                if sums is not None:
                    yield _pairs(grp, grp, sums)

    sums = rows.mapInArrow(run, "grp int, other int, value long").groupBy("grp", "other").agg(F.sum("value").alias("value"))
    left = groups.select("lang", "source", "grp", "lang_no")
    right = groups.select(F.col("source").alias("item"), F.col("grp").alias("other"), "lang_no")
    # the result's own rows: each other source of the same language
    pairs = left.join(right, "lang_no").filter("grp != other").join(sums, ["grp", "other"], "left")
    return pairs.select("lang", "source", "grp", "item", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def _pairs(left: np.ndarray, right: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.repeat(left, len(right)).astype(np.int32)), pa.array(np.tile(right, len(left)).astype(np.int32)),
                                       pa.array(value.ravel())], ["grp", "other", "value"])


def term_values(terms: SourceTerms, groups: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value of each group's kept terms above the language's share, down to the ``top``-th value with its ties.

    Ranked by value on fixed-width rows; strings join the rows that remain.
    """
    each = terms.counts.select("digest", "name", "lang_n", F.explode("by_group").alias("g")).select("digest", "name", "lang_n", F.col("g.grp").alias("grp"), F.col("g.n").alias("n"))
    each = each.join(broadcast_if_small(groups), "grp")
    p, q = share(F.col("n"), F.col("total"), F.col("distinct")), share(F.col("lang_n"), F.col("lang_total"), F.col("distinct"))
    above = each.select("lang", "source", "lang_no", "grp", "digest", "name", p.alias("p"), q.alias("q")).filter("p > q")
    valued = above.select("lang", "source", "lang_no", "grp", "digest", "name", F.expr("(p - q) * (p - q) div q").alias("value"))
    # a limit on the rank is applied in every task before the shuffle; parts of a group first, so that a large one is not ranked by one task
    first = valued.withColumn("salt", F.pmod(F.xxhash64("digest", "name"), F.lit(TOP_PARTS)))
    for keys in (["grp", "salt"], ["grp"]):
        first = first.withColumn("place", F.rank().over(Window.partitionBy(*keys).orderBy(F.desc("value")))).filter(F.col("place") <= top).drop("place")
    first = stored(first.drop("salt"), "top-digests")
    plain = first.filter(F.col("name").isNull()).join(terms.strings, ["lang_no", "digest"]).withColumn("item", F.col("term"))
    named = first.filter(F.col("name").isNotNull()).withColumn("item", F.col("name"))
    return plain.select("lang", "source", "grp", "item", "value").unionByName(named.select("lang", "source", "grp", "item", "value"))


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, bits: int = DIGEST_BITS) -> DataFrame:
    """lang, source, part ("pair" or "term"), item, value, rank (from 1 per group and part: value descending, item ascending)."""
    terms = SourceTerms(docs, min_docs, bits)
    groups, _ = _totals(terms)
    ranked = Window.partitionBy("grp").orderBy(F.desc("value"), "item")
    pairs = pair_values(terms, groups).withColumn("rank", F.row_number().over(ranked))
    best = term_values(terms, groups, top).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top)
    columns = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return columns(pairs, "pair").unionByName(columns(best, "term"))

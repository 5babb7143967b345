"""Near-duplicate groups by ProbMinHash signatures, banding and exact verification.

A text is its multiset of five-word shingles (lower-cased words of letters and
digits; a text of fewer words is one shingle), weighted ``1 + ln(count)``.
Each shingle starts a Poisson process whose rate is its weight; its arrivals
fall on random signature components, a component keeps the earliest arrival's
shingle, and a process ends when its next arrival is later than every
component's (early termination).  Two signatures agree in a component with the
probability Jaccard similarity of the texts.

1. Equal word sequences are one node.
2. ``BANDS`` bands of ``ROWS`` components; the nodes of a band bucket are
   linked to the bucket's centre (a star, never all pairs), the node whose
   buckets hold most nodes: in a family of edited copies that is the text the
   others were made from.
3. Candidate links whose signatures agree well enough are verified exactly on
   the shingles; links of a similarity of ``SIMILARITY`` or more stay.
4. Connected components (large star, small star) give the classes.
5. Buckets that still hold several classes are compared inside tasks, the
   members of their largest class only with the others, in blocks of bounded
   size, each pair in the first bucket it shares, and decided on the whole
   shingles there.  The tasks report one link for each pair of classes: what
   they skip lies in classes that a true link joins, a link is not lost
   because its ends were compared with a third text only, and the many pairs
   that fall short leave no rows.

Signatures miss a link of similarity 0.8 with a probability of about 3e-5 by
banding and 3e-5 by the agreement bound.

Defined cases: a text without words (null, empty, punctuation) is a class of
its own row; repeated rows belong to one class; the class id is the smallest
doc_id of the class (null only if all are null); other columns, whatever their
names, pass through ``deduplicate`` unchanged; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metroscope.llm.runtime import blocks, doc_text, each_row, plain, quoted, stored, string_column
from metroscope.llm.words import Words, inside_text, mix, split, windows

SHINGLE = 5
LEAST = (4, 5)  # the smallest similarity that links, as a fraction
SIMILARITY = LEAST[0] / LEAST[1]
ROUNDING = 1e-12  # what the sums of a similarity of unequal weights may lose
ROWS, BANDS = 4, 20
PARTS = 2 * ROWS * BANDS  # the bands use the first half; all serve to estimate
AGREE = SIMILARITY - 4 * (SIMILARITY * (1 - SIMILARITY) / PARTS) ** 0.5  # four standard deviations below
BLOCK = 1000  # members of a bucket compared in one task at a time


# ------------------------------------------------------------------ texts
def sequences(w: Words, h: np.ndarray) -> list[bytes | None]:
    """A 128-bit name of each text's word sequence; None without words."""
    n, count = len(w.first) - 1, w.counts
    at = np.arange(len(w)) - np.repeat(w.first[:-1], count)
    out = []
    for seed in (1, 2):
        base = np.uint64(int(mix(np.array([seed], np.uint64), 77)[0]) | 1)
        power = np.cumprod(np.full(int(count.max()) if n else 0, base, np.uint64))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h, 50 + seed) * power[at])]) if len(w) else np.zeros(1, np.uint64)
        out.append(mix((total[w.first[1:]] - total[w.first[:-1]]) ^ mix(count.astype(np.uint64)), seed))
    names = np.column_stack(out)
    return [names[i].tobytes() if count[i] else None for i in range(n)]


def shingles(w: Words, h: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of the distinct shingles, by text and shingle."""
    at = inside_text(w, k)
    text = np.searchsorted(w.first, at, side="right") - 1
    value = windows(h, k, 3)[at] if len(at) else np.zeros(0, np.uint64)
    few = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(few):
        names = sequences(w, h)
        text = np.concatenate([text, few])
        value = np.concatenate([value, np.array([np.frombuffer(names[i], np.uint64)[0] for i in few], np.uint64)])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    first = np.flatnonzero(new)
    return text[first], value[first], 1 + np.log(np.diff(np.append(first, len(text))))


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, parts: int = PARTS) -> np.ndarray:
    """ProbMinHash: for each of ``n`` texts the earliest shingle (32 bits of it) of every component."""
    earliest, who = np.full(n * parts, np.inf), np.zeros(n * parts, np.uint32)
    limit = np.full(n, np.inf)
    time, arrival = np.zeros(len(text)), 0
    while len(text):
        arrival += 1
        r = mix(shingle, 1000 + arrival)
        time = time - np.log(((r >> np.uint64(32)).astype(np.float64) + 0.5) / 4294967296.0) / weight
        slot = text * parts + (((r & np.uint64(0xFFFFFFFF)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(earliest, slot, time)
        won = earliest[slot] == time
        who[slot[won]] = (shingle[won] >> np.uint64(13)).astype(np.uint32)
        live = np.unique(text)
        limit[live] = earliest.reshape(n, parts)[live].max(1)
        go = time < limit[text]
        text, shingle, weight, time = text[go], shingle[go], weight[go], time[go]
    return who.reshape(n, parts)


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit bucket for each band of each signature."""
    n = len(signature)
    out = np.zeros((n, BANDS), np.uint64)
    cut = signature[:, :ROWS * BANDS].reshape(n, BANDS, ROWS).astype(np.uint64)
    for r in range(ROWS):
        out = mix(out ^ cut[:, :, r], 5 + r)
    return mix(out + np.arange(BANDS, dtype=np.uint64), 9)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard similarity of two (sorted shingles, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    w, v = a[1][i].astype(float), b[1][j].astype(float)
    only_a, only_b = a[1].sum() - w.sum(), b[1].sum() - v.sum()
    # sum_j max(w_j/w_i, v_j/v_i): common j with w_j/v_j above i's ratio count w_j/w_i, the others v_j/v_i
    order = np.argsort(-w / v, kind="stable")
    w, v = w[order], v[order]
    upto_w, after_v = np.cumsum(w), v.sum() - np.cumsum(v)
    return float((1 / ((only_a + upto_w) / w + (only_b + after_v) / v)).sum())


def enough(common: int, union: int) -> bool:
    """Whether ``common / union`` is SIMILARITY or more, in integers."""
    return LEAST[1] * common >= LEAST[0] * union


def linked(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> bool:
    """Whether two (sorted shingles, weights) have a similarity of SIMILARITY or more."""
    if all((w == w[0]).all() for _, w in (a, b)):  # equal weights in each: the plain Jaccard similarity
        common = len(np.intersect1d(a[0], b[0], assume_unique=True))
        return enough(common, len(a[0]) + len(b[0]) - common)
    return similarity(a, b) >= SIMILARITY - ROUNDING


# ------------------------------------------------------------------ Spark steps
def describe(docs: DataFrame) -> DataFrame:
    """(doc_id, node, signature, bands) of every row, stored once; the last three are null without words."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches):
            w = split(string_column(b, "text"), "alnum")
            h, n = w.hashes(), b.num_rows
            names = sequences(w, h)
            sig = signatures(*shingles(w, h), n)
            keys = bands(sig).view(np.int64)
            some = [name is not None for name in names]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(names, pa.binary()),
                 pa.array([s.tobytes() if ok else None for s, ok in zip(sig, some)], pa.binary()),
                 pa.array([k if ok else None for k, ok in zip(keys.tolist(), some)], pa.list_(pa.int64()))],
                ["doc_id", "node", "signature", "bands"])

    return stored(doc_text(docs).mapInArrow(run, "doc_id long, node binary, signature binary, bands array<long>"), "signatures")


def agreeing(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least AGREE of the components."""
    left = nodes.select(F.col("node").alias("a"), F.col("signature").alias("sa"))
    right = nodes.select(F.col("node").alias("b"), F.col("signature").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                s = [np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, PARTS) for c in ("sa", "sb")]
                yield b.select(["a", "b"]).filter(pa.array((s[0] == s[1]).mean(1) >= AGREE))

    return pairs.join(left, "a").join(right, "b").mapInArrow(run, "a binary, b binary")


def bags(wanted: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, shingle, weight) of the wanted nodes, from their whole texts; stored once.  ``weight`` is null where all are 1."""
    def run(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches):
            w = split(string_column(b, "text"), "alnum")
            h = w.hashes()
            text, shingle, weight = shingles(w, h)
            at = np.searchsorted(text, np.arange(b.num_rows + 1))
            parts = [(shingle[at[i]:at[i + 1]].tobytes(), weight[at[i]:at[i + 1]]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(sequences(w, h), pa.binary()), pa.array([x for x, _ in parts], pa.binary()),
                 pa.array([None if (v == 1).all() else v.tobytes() for _, v in parts], pa.binary())], ["node", "shingle", "weight"])

    # texts are fetched by doc_id; a row may repeat an id, so nodes are computed again and matched.  The ids are
    # stored first: their file size tells the planner whether a broadcast spares the shuffle of all texts.
    ids = stored(wanted.join(nodes, "node").select("first_id").distinct(), "wanted-ids")
    texts = doc_text(docs).join(ids, F.col("doc_id").eqNullSafe(F.col("first_id")), "left_semi")
    found = texts.mapInArrow(run, "node binary, shingle binary, weight binary").filter("node is not null").dropDuplicates(["node"])
    return stored(found, "shingles")


def _bag(shingle: bytes, weight: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    h = np.frombuffer(shingle, np.uint64)
    return h, np.ones(len(h)) if weight is None else np.frombuffer(weight, np.float64)


def verified(pairs: DataFrame, own: DataFrame) -> DataFrame:
    """The pairs (a, b) of at least SIMILARITY, computed on the shingles ``own`` of their whole texts."""
    left = own.select(F.col("node").alias("a"), F.col("shingle").alias("xa"), F.col("weight").alias("wa"))
    right = own.select(F.col("node").alias("b"), F.col("shingle").alias("xb"), F.col("weight").alias("wb"))

    def check(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            keep = [linked(_bag(r["xa"], r["wa"]), _bag(r["xb"], r["wb"])) for r in each_row([b])]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return stored(pairs.join(left, "a").join(right, "b").mapInArrow(check, "a binary, b binary"), "links")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes that have links; the root is the component's smallest node.

    Large-star and small-star steps in turn; minima are joined back, so the
    neighbours of a hub are never gathered.
    """
    def mark(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    before = mark(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = stored(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = (small.select("a", F.col("m").alias("b")).unionByName(small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
                 .filter("a <> b").distinct())
        edges = stored(small, "small-star")
        now = mark(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def mixed_members(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Members (band, node, root, guest, hosts, guests) of the buckets that hold several classes.

    ``guest`` marks members outside the bucket's largest class; ``hosts`` and
    ``guests`` are the numbers of blocks of BLOCK members of either kind.
    """
    named = shared.join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    sizes = named.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = (sizes.groupBy("band").agg(F.count(F.lit(1)).alias("classes"), F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
             .filter("classes > 1")
             .select("band", F.col("top.root").alias("host"),
                     F.ceil(F.col("top.n") / BLOCK).cast("int").alias("hosts"),
                     F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("guests")))
    return stored(named.join(mixed, "band").withColumn("guest", F.col("root") != F.col("host")).drop("host"), "mixed-buckets")


def crossing(members: DataFrame, nodes: DataFrame, own: DataFrame) -> DataFrame:
    """Links (a, b) between different classes that meet in a bucket, compared inside the tasks.

    The members of a bucket's largest class are compared with the guests, and
    the guests among themselves; blocks of BLOCK members meet in one task, a
    pair in the first bucket it shares.  The similarity is that of the whole
    shingles, as in ``verified``, so a class pair needs its first link only.
    """
    spread = F.pmod(F.xxhash64("node"), F.when(F.col("guest"), F.col("guests")).otherwise(F.col("hosts"))).cast("int")
    rows = members.withColumn("own", spread)
    # tasks: ("h", host block, guest block) and ("g", guest block, later guest block)
    hosts = F.transform(F.sequence(F.lit(0), F.col("guests") - 1), lambda g: F.struct(F.lit("h").alias("kind"), F.col("own").alias("x"), g.alias("y")))
    guests = F.concat(
        F.transform(F.sequence(F.lit(0), F.col("hosts") - 1), lambda h: F.struct(F.lit("h").alias("kind"), h.alias("x"), F.col("own").alias("y"))),
        F.transform(F.sequence(F.lit(0), F.col("guests") - 1),
                    lambda g: F.struct(F.lit("g").alias("kind"), F.least(g, "own").alias("x"), F.greatest(g, "own").alias("y"))))
    rows = rows.withColumn("task", F.explode(F.when(F.col("guest"), guests).otherwise(hosts)))

    rows = (rows.join(nodes.select("node", "bands").join(own, "node"), "node")
            .select("band", "task.kind", "task.x", "task.y", "node", "root", "guest", "bands", "shingle", "weight"))

    def compare(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members = sorted(each_row(batches), key=lambda r: (r["guest"], r["root"], r["node"]))
        keys = np.array([r["bands"] for r in members])
        here = int(np.flatnonzero(keys[0] == key[0].as_py())[0])
        plain = np.array([r["weight"] is None for r in members])
        size = np.array([len(r["shingle"]) // 8 for r in members])
        flat, first = np.frombuffer(b"".join(r["shingle"] for r in members), np.uint64), np.concatenate([[0], np.cumsum(size)])
        ids, root = np.unique(np.array([r["root"].hex() for r in members]), return_inverse=True)
        found = []
        for i in [i for i, r in enumerate(members) if r["guest"]]:  # guests come after hosts
            near = np.flatnonzero(root[:i] != root[i])
            near = near[(keys[near] == keys[i]).argmax(1) == here] if len(near) else near
            # a similarity of SIMILARITY needs sizes within that ratio, where no weights are involved
            fits = ~(plain[near] & plain[i]) | (np.minimum(size[near], size[i]) >= SIMILARITY * np.maximum(size[near], size[i]) - 1)
            near = near[fits]
            if not len(near):
                continue
            at = np.concatenate([np.arange(first[j], first[j + 1]) for j in near.tolist()])
            mine = flat[first[i]:first[i + 1]]
            place = np.minimum(np.searchsorted(mine, flat[at]), size[i] - 1) if plain[i] else None
            common = (np.add.reduceat((mine[place] == flat[at]).astype(np.int64), np.cumsum(size[near]) - size[near])
                      if plain[i] else np.zeros(len(near), np.int64))
            for j, c in zip(near.tolist(), common.tolist()):
                if root[j] == root[i]:
                    continue  # joined meanwhile
                if plain[i] and plain[j]:
                    link = enough(c, size[i] + size[j] - c)
                else:
                    link = linked(*(_bag(members[k]["shingle"], members[k]["weight"]) for k in (i, j)))
                if link:
                    found.append((max(members[i]["node"], members[j]["node"]), min(members[i]["node"], members[j]["node"])))
                    root[root == root[j]] = root[i]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.binary()) for k in (0, 1)], ["a", "b"])

    return stored(rows.groupBy("band", "kind", "x", "y").applyInArrow(compare, "a binary, b binary").distinct(), "crossing")


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, class_id, class_size) of every row; node is null without words."""
    rows = describe(docs)
    worded = rows.filter("node is not null")
    nodes = stored(worded.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"),
                                              F.first("bands").alias("bands")), "nodes")
    buckets = nodes.select(F.explode("bands").alias("band"), "node")
    sizes = buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = stored(buckets.join(sizes, "band"), "shared-buckets")
    fame = shared.groupBy("node").agg(F.sum("n").alias("fame"))
    centre = shared.join(fame, "node").groupBy("band").agg(F.max(F.struct("fame", "node")).alias("c")).select("band", F.col("c.node").alias("c"))
    stars = (shared.join(centre, "band").filter("node <> c")
             .select(F.greatest("node", "c").alias("a"), F.least("node", "c").alias("b")).distinct())
    tried = stored(agreeing(stars, nodes), "candidates")
    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = verified(tried, bags(ends(tried), docs, nodes))
    roots = components(links)
    members = mixed_members(shared, roots)
    own = bags(members.select("node").distinct(), docs, nodes)
    new = crossing(members, nodes, own)  # every other pair was compared, or lies in a class that is joined now
    if new.count():
        roots = components(links.unionByName(new))
    named = nodes.join(roots, "node", "left").select("node", "first_id", F.coalesce("root", "node").alias("root"))
    counts = worded.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    whole = (named.join(counts, "node").groupBy("root").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size")))
    by_node = named.join(whole, "root").select("node", "class_id", "class_size")
    return (rows.join(by_node.withColumnRenamed("node", "n2"), F.col("node") == F.col("n2"), "left")
            .select("doc_id", "node", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("class_size", F.lit(1)).alias("class_size")))


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, class_id, class_size, kept (it is the class's smallest doc_id)."""
    return classes(docs).select("doc_id", "class_id", "class_size", F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each class, all columns; every text without words stays.

    Of a class, the row with the smallest doc_id stays (of several texts with
    that id, one).
    """
    names, docs = docs.columns, plain(docs)
    mark = "__n" + hashlib.md5("|".join(docs.columns).encode()).hexdigest()[:8]
    schema = ", ".join([f"{quoted(f.name)} {f.dataType.simpleString()}" for f in docs.schema] + [f"`{mark}` binary"])

    def run(batches: Iterator[pa.RecordBatch]):
        for b in blocks(batches):
            w = split(string_column(b, "text"), "alnum")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sequences(w, w.hashes()), pa.binary())], [*b.schema.names, mark])

    named = docs.mapInArrow(run, schema)
    keep = (classes(docs).filter("node is not null and doc_id <=> class_id").groupBy("class_id").agg(F.min("node").alias("node"))
            .select(F.col("class_id").alias(f"{mark}i"), F.col("node").alias(f"{mark}n")))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(f"{mark}i")) & (F.col(mark) == F.col(f"{mark}n"))
    chosen = named.filter(F.col(mark).isNotNull()).join(keep.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", mark])
    return chosen.unionByName(named.filter(F.col(mark).isNull())).drop(mark).toDF(*names)

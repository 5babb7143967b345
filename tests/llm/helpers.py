"""Plain-Python twins of the operators and the awkward documents every operator must take."""

import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"
SPACE, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

# columns whose names operators also use inside
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())]
                      + [T.StructField(n, T.StringType()) for n in ("lang", "source", "digest", "node", "score", "chunk", "row", "keep_id")]
                      + [T.StructField("n_chars", T.LongType())])
LONG = " ".join(f"word{i % 977}x{i}" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = [
    (1, None), (2, ""), (3, "   \n\t "), (4, "Alpha beta GAMMA delta"), (5, "alpha BETA gamma delta"), (6, LONG),
    (7, "intro one two " + PASSAGE + " tail seven"), (8, "other start " + PASSAGE + " different end of it"),
    (9, "Ünïcode wörds ünd ÄÖÜ tokens 数字 １２３   non breaking"), (9, "Ünïcode wörds ünd ÄÖÜ tokens 数字 １２３   non breaking"),
    (10, "x"), (11, "!!! ... ???"), (None, "a row without an id"), (None, None), (12, LONG + " one more end"),
    (13, "Released under the MIT License. <|endoftext|> it's GNU  General-Public LICENSE, don't"),
]


def low(t):
    return (t or "").translate(_LOWER)


def rows(texts):
    return [(i, t, "en", "s", "d", "n", "0.5", "c", "r", "k", len(t or "")) for i, t in texts]


def awkward(spark, texts=None):
    return spark.createDataFrame(rows(TEXTS if texts is None else texts), SCHEMA)


def small_documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=lambda p: (p[0] is not None, p[0], p[1] or ""))


def substring_dedup(texts, k=50):
    """(id, n_words, n_removed, kept text) of each row, by brute force."""
    smallest = -1
    key = lambda i: smallest if i is None else i
    first = {}
    for i, t in texts:
        w = SPACE.findall(t or "")
        for s in range(len(w) - k + 1):
            g = tuple(w[s:s + k])
            first[g] = min(first.get(g, key(i)), key(i))
    out = []
    for i, t in texts:
        w, gone = SPACE.findall(t or ""), set()
        for s in range(len(w) - k + 1):
            if first[tuple(w[s:s + k])] < key(i):
                gone.update(range(s, s + k))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def contamination(texts, items, k=10):
    windows = defaultdict(set)
    for item, t in items:
        w = ALNUM.findall(low(t))
        for s in range(max(1, len(w) - k + 1) if w else 0):
            windows[tuple(w[s:s + k])].add(str(item))
    sizes, out = sorted({len(g) for g in windows}), []
    for i, t in texts:
        w, hit, found = ALNUM.findall(low(t)), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                got = windows.get(tuple(w[s:s + n]))
                if got:
                    hit.update(range(s, s + n))
                    found |= got
        out.append((i, len(w), len(hit), sorted(found)))
    return out


def weighted_shingles(t, k=5):
    import math
    w = ALNUM.findall(low(t))
    grams = [tuple(w[s:s + k]) for s in range(len(w) - k + 1)] or ([tuple(w)] if w else [])
    return {g: 1 + math.log(n) for g, n in Counter(grams).items()}


def probability_jaccard(a, b):
    if {*a.values(), *b.values()} == {1.0}:  # equal weights: the plain Jaccard similarity
        return len(a.keys() & b.keys()) / len(a.keys() | b.keys())
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def near_classes(texts, at_least=0.8):
    bags = [weighted_shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    inverted = defaultdict(list)
    for n, bag in enumerate(bags):
        for g in bag:
            inverted[g].append(n)
    tried = set()
    for members in inverted.values():
        for x in members:
            for y in members:
                if x < y and (x, y) not in tried:
                    tried.add((x, y))
                    if find(x) != find(y) and len(bags[x].keys() & bags[y].keys()) > 0.4 * max(len(bags[x]), len(bags[y])) \
                            and probability_jaccard(bags[x], bags[y]) >= at_least:
                        root[max(find(x), find(y))] = min(find(x), find(y))
    return [find(n) for n in range(len(texts))]

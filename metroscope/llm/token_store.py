"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

File format (a folder):

* ``dictionary``: one parquet row (dict_sha256, dictionary, id_bytes);
* ``frames``: parquet rows, one per block of documents in ascending doc_id
  order: shard, block, start_in_shard (ids before the block in its shard),
  n_ids, first_id, last_id, dict_sha256, doc_ids (int64 little-endian),
  present (one byte per document, 0 where the doc_id is null), lengths (uint32 ids per document),
  offsets (uint32 byte offset of each frame, one more than documents), frames
  (the zstandard frames, each an array of 16- or 32-bit ids).

One document is read by its block (parquet statistics of first_id / last_id),
its slot in doc_ids and its frame alone; the dictionary is named by its hash
in every block, so a wrong one is refused.

The dictionary is trained on the id arrays of a bounded sample (the documents
with the smallest hashed ids); it changes sizes only, never contents.  Shards
are ranges of doc_id cut at quantiles, so each is written by one task and the
number of shards follows the input; only compressed frames are shuffled.

Defined cases: a null or empty text has the end id only; rows that repeat a
doc_id are all kept, next to each other; null doc_ids come first; an empty
table gives a store without blocks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metroscope.llm.runtime import blocks, doc_text, parts_for, string_column
from metroscope.llm.tokens import Encoder

LEAST = -(1 << 63)      # where null doc_ids, which come first, are ordered
SAMPLE_DOCS = 512       # documents the dictionary is trained on
SAMPLE_IDS = 2048       # ids of each that are used for it
DICT_BYTES = 64 << 10
LEVEL = 3
BLOCK_DOCS, BLOCK_IDS = 1024, 1 << 20
FRAMES = ("shard int, block int, start_in_shard long, n_ids long, first_id long, last_id long, dict_sha256 string, "
          "doc_ids binary, present binary, lengths binary, offsets binary, frames binary")


def _train(sample: list[bytes]) -> bytes:
    import zstandard
    if sum(map(len, sample)) < 20 * 1024 or len(sample) < 16:
        return b"".join(sample)[:DICT_BYTES]  # too little to train on: raw content serves as the dictionary
    try:
        return zstandard.train_dictionary(DICT_BYTES, sample).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:DICT_BYTES]


def train_dictionary(docs: DataFrame, tokenizer: str, end_id: int, id_type: str, added: bool = False) -> bytes:
    """Dictionary from the serialized ids of at most SAMPLE_DOCS documents (smallest hashed doc_ids)."""
    chosen = [r[0] for r in docs.select("doc_id").filter("doc_id is not null")
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).collect()]
    if not chosen:
        return b""

    def ids(batches: Iterator[pa.RecordBatch]):
        encoder = Encoder(tokenizer, added)
        for b in blocks(batches):
            flat, off = encoder.encode(string_column(b, "text"), end_id)
            raw = [flat[off[i]:off[i + 1]][:SAMPLE_IDS].astype(id_type).tobytes() for i in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(raw, pa.binary())], ["doc_id", "raw"])

    rows = docs.filter(F.col("doc_id").isin(chosen)).mapInArrow(ids, "doc_id long, raw binary").limit(4 * SAMPLE_DOCS).collect()
    return _train([bytes(r.raw) for r in sorted(rows, key=lambda r: (r.doc_id, bytes(r.raw)))])


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_type: str = "<u2", added: bool = False) -> None:
    """Write the token-id store of ``docs`` to ``path``; ``id_type`` must hold the vocabulary."""
    spark = docs.sparkSession
    docs = doc_text(docs)
    dictionary = train_dictionary(docs, tokenizer, end_id, id_type, added)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, dictionary, int(id_type[-1]))], "dict_sha256 string, dictionary binary, id_bytes int") \
        .coalesce(1).write.parquet(f"{path}/dictionary")
    shards = parts_for(docs, 32 << 20)
    cuts = docs.approxQuantile("doc_id", [k / shards for k in range(1, shards)], 0.2 / shards) if shards > 1 else []
    cuts = np.array(cuts, np.float64)

    def compress(batches: Iterator[pa.RecordBatch]):
        import zstandard
        frame = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        encoder = Encoder(tokenizer, added)
        for b in blocks(batches):
            flat, off = encoder.encode(string_column(b, "text"), end_id)
            if flat.size and int(flat.max()) > np.iinfo(id_type).max:
                raise ValueError(f"token id {int(flat.max())} does not fit into {id_type}")
            flat = flat.astype(id_type)
            width = flat.dtype.itemsize
            raw = memoryview(flat.tobytes())
            out = [frame.compress(raw[off[i] * width:off[i + 1] * width]) for i in range(len(off) - 1)]
            key = b.column("doc_id")
            shard = np.searchsorted(cuts, key.fill_null(LEAST).to_numpy(zero_copy_only=False), side="left")
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), key, pa.array(np.diff(off), pa.int64()),
                                              pa.array(out, pa.binary())], ["shard", "doc_id", "n", "frame"])

    def layout(batches: Iterator[pa.RecordBatch]):
        before = {"shard": None, "block": 0, "ids": 0}

        def block(rows: list) -> pa.RecordBatch:
            shard = rows[0][0]
            if before["shard"] != shard:
                before.update(shard=shard, block=0, ids=0)
            n = np.array([r[2] for r in rows], "<u4")
            sizes = np.array([0, *(len(r[3]) for r in rows)])
            ids = [LEAST if r[1] is None else r[1] for r in rows]
            values = (shard, before["block"], before["ids"], int(n.sum()), ids[0], ids[-1], name,
                      np.array(ids, "<i8").tobytes(), bytes(r[1] is not None for r in rows), n.tobytes(), np.cumsum(sizes).astype("<u4").tobytes(),
                      b"".join(r[3] for r in rows))
            before.update(block=before["block"] + 1, ids=before["ids"] + int(n.sum()))
            types = [pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.string(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], [c.split()[0] for c in FRAMES.split(", ")])

        rows, ids = [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns)):
                if rows and (r[0] != rows[0][0] or len(rows) >= BLOCK_DOCS or ids + r[2] > BLOCK_IDS):
                    yield block(rows)
                    rows, ids = [], 0
                rows.append(r)
                ids += r[2]
        if rows:
            yield block(rows)

    (docs.mapInArrow(compress, "shard int, doc_id long, n long, frame binary")
     .repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "doc_id", "n", "frame")
     .mapInArrow(layout, FRAMES).write.option("compression", "uncompressed").parquet(f"{path}/frames"))


class Store:
    """A written store."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.name, self.dictionary, width = spark.read.parquet(f"{path}/dictionary").first()
        self.id_type = f"<u{width}"

    def frames(self) -> DataFrame:
        return self.spark.read.schema(FRAMES).parquet(f"{self.path}/frames")

    def _decoder(self):
        """Function from a block (dict of columns) to its documents' ids; refuses a wrong dictionary."""
        name, dictionary, id_type = self.name, bytes(self.dictionary), self.id_type

        def decode(row: dict, only=None):
            import zstandard
            if row["dict_sha256"] != name or hashlib.sha256(dictionary).hexdigest() != name:
                raise ValueError("the block names another dictionary")
            plain = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
            off, lengths = np.frombuffer(row["offsets"], "<u4"), np.frombuffer(row["lengths"], "<u4")
            frames, width = memoryview(row["frames"]), int(id_type[-1])
            for i in range(len(lengths)) if only is None else only:
                ids = np.frombuffer(plain.decompress(frames[off[i]:off[i + 1]], max_output_size=int(lengths[i]) * width), id_type)
                if len(ids) != lengths[i]:
                    raise ValueError("a frame does not hold the ids its index names")
                yield ids.astype("<u4")
        return decode

    def documents(self, with_ids: bool = False) -> DataFrame:
        """One row per stored document, read from the files: doc_id, start, n_tokens, ids_crc32 (and ids)."""
        # one number per shard; the shards' starts follow from them
        totals = dict(self.frames().groupBy("shard").agg(F.max(F.col("start_in_shard") + F.col("n_ids"))).collect())
        base, seen = {}, 0
        for shard in sorted(totals):
            base[shard], seen = seen, seen + totals[shard]
        decode = self._decoder()
        names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids

        def run(batches: Iterator[pa.RecordBatch]):
            for b in batches:
                for i in range(b.num_rows):
                    row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                    n = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
                    raw = [x.tobytes() for x in decode(row)]
                    start = base[row["shard"]] + row["start_in_shard"] + np.cumsum(n) - n
                    doc = np.frombuffer(row["doc_ids"], "<i8")
                    cols = [pa.array(doc, mask=np.frombuffer(row["present"], np.uint8) == 0), pa.array(start), pa.array(n),
                            pa.array([zlib.crc32(x) for x in raw], pa.int64())] + [pa.array(raw, pa.binary())] * with_ids
                    yield pa.RecordBatch.from_arrays(cols, names)

        return self.frames().mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)

    def document(self, doc_id: int) -> list[np.ndarray]:
        """The ids of one document (of each row with this doc_id): only its blocks are read, only its frames decompressed."""
        found = self.frames().filter((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).collect()
        decode, out = self._decoder(), []
        for row in sorted((r.asDict() for r in found), key=lambda r: (r["shard"], r["block"])):
            named = (np.frombuffer(row["doc_ids"], "<i8") == doc_id) & (np.frombuffer(row["present"], np.uint8) == 1)
            out += decode(row, np.flatnonzero(named).tolist())
        return out

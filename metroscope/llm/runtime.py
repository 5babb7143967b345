"""Helpers of the training-data operators: shared scratch tables, input sizing, batch streams."""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metroscope.session import ensure_checkpoint_dir

# text bytes handled at a time by a Python worker; a longer text is one block of its own
BLOCK_BYTES = 4 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder (``spark.checkpoint.dir``)."""
    return f"{ensure_checkpoint_dir(spark)}/llm/{name}-{uuid.uuid4().hex[:12]}"


def quoted(name: str) -> str:
    """A column name as it must be written in an expression or a schema, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def plain(df: DataFrame) -> DataFrame:
    """The same columns with names that Arrow functions take: a name with other characters than letters, digits and
    ``_`` becomes its position; the caller gives the names back with ``toDF``."""
    mark = "__p" + hashlib.md5("|".join(df.columns).encode()).hexdigest()[:8]
    return df.toDF(*[c if re.fullmatch(r"[A-Za-z0-9_]+", c) else f"{mark}{i}" for i, c in enumerate(df.columns)])


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts lineage: a lost executor re-reads files instead of recomputing, and
    several consumers see the same rows.
    """
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """How many hash slices ``df`` is worth: its estimated size over ``bytes_each``,
    at least the session's shuffle partitions, so slices stay bounded as the input grows."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= 1 << 60:  # the planner knows nothing about this input: measure it
        wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.typeName() in ("string", "binary")]
        size = df.select(sum(wide, F.lit(8)).alias("n")).agg(F.sum("n")).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // bytes_each + 1)


def string_column(batch: pa.RecordBatch, name: str) -> pa.StringArray:
    """A text column with nulls as empty strings."""
    col = batch.column(name)
    if pa.types.is_null(col.type):
        col = pa.nulls(len(col), pa.string())
    return col.fill_null("") if col.null_count else col


def raw_text(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; offsets start at 0."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0]:off[-1]], off - off[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that each holds at most ``limit`` text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = raw_text(string_column(batch, text))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def doc_text(docs: DataFrame) -> DataFrame:
    """The two columns most operators read: ``doc_id`` (long) and ``text`` (null stays null)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


# ------------------------------------------------------------------ chunks
CHUNK = "chunk long, data binary"


def chunk_table(docs: DataFrame, name: str, limit: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id`` and ``text`` of all rows in chunks of at most ``limit`` text bytes (or one row), stored once.

    A chunk is one row: its number and its rows as a compressed Arrow stream.
    Hash messages to other tasks then go by chunk instead of by word, and a
    lost task re-reads the stored table, so chunk numbers never change.
    """
    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        task, k = TaskContext.get().partitionId(), 0
        for waiting in gather(blocks(batches, limit=limit), limit):
            yield pa.RecordBatch.from_arrays([pa.array([task << 32 | k]), pa.array([pack_rows(waiting)], pa.binary())], ["chunk", "data"])
            k += 1

    def gather(parts, limit):
        rows, size = [], 0
        for b in parts:
            n = string_column(b, "text").nbytes
            if rows and size + n > limit:
                yield rows
                rows, size = [], 0
            rows.append(b)
            size += n
        if rows:
            yield rows

    path = scratch(docs.sparkSession, name)
    doc_text(docs).mapInArrow(run, CHUNK).write.option("compression", "uncompressed").parquet(path)
    return docs.sparkSession.read.schema(CHUNK).parquet(path)


def pack_rows(batches: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batches[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for b in batches:
            out.write_batch(b)
    return sink.getvalue().to_pybytes()


def unpack_rows(data: bytes) -> tuple[list, pa.StringArray]:
    """(doc_ids, texts) of a chunk; null texts are empty."""
    table = pa.ipc.open_stream(data).read_all().combine_chunks()
    batch = table.to_batches()[0]
    return batch.column("doc_id").to_pylist(), string_column(batch, "text")


def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches as dicts, one at a time."""
    for b in batches:
        for i in range(b.num_rows):
            yield {c: b.column(c)[i].as_py() for c in b.schema.names}


def slice_of(h: np.ndarray, n: int) -> np.ndarray:
    """Slice 0..n-1 of each 64-bit hash, in ascending hash order."""
    return ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)


def slice_bounds(h: np.ndarray, n: int) -> np.ndarray:
    """For sorted hashes: first position of each slice, and the end."""
    return np.searchsorted(slice_of(h, n), np.arange(n + 1))


def squeeze(a: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def spread_out(data: bytes, dtype) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)

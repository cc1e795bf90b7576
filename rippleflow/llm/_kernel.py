"""Shared vector kernels over Arrow text columns, and small Spark helpers.

A text column arrives as one UTF-8 byte buffer plus row offsets; everything below works on
those two arrays, so the cost per byte does not depend on how the bytes fall into rows.
Nulls count as empty texts throughout.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch, whichever is less; texts may be long, so batches stay small.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: Bytes that a kernel works on at once, unless a single text is longer.
BLOCK_BYTES = 2 << 20

#: ASCII white space of the word pattern [^\x20\x09-\x0D]+.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches: a batch of long texts must fit in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column) -> Column:
    """The document's fold, 0 to 2: crc32 of the decimal doc_id, modulo 3. A null id is in fold 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3, F.lit(0)).cast("int")


def sampled(df: DataFrame, key: str, limit: int, text: str = "text") -> DataFrame:
    """The texts of at most limit documents, those whose keys have the least hashes, one row for each key.

    Of several rows of a key, the one whose text has the least hash stands for it. The choice depends
    on the rows alone, not on their order or partitions.
    """
    ids = df.select(F.col(key).alias("_id")).where("_id is not null").distinct().orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = df.select(F.col(key).alias("_key"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.join(F.broadcast(ids), F.col("_key") == F.col("_id"))  # at most `limit` ids
    return one_each(rows, "_key").select("text")


def one_each(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key: the one whose text has the least hash, and of equal hashes the least text."""
    rest = [c for c in rows.columns if c != key]
    one = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(F.xxhash64("text"), "text")).alias("_one"))
    return one.select(key, "_one.*")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    A machine-local folder serves only where the setting is absent and the master is local.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = "file://" + os.path.join(tempfile.gettempdir(), "rippleflow-checkpoints")
    return f"{root.rstrip('/')}/rf-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes the folders of stored() tables that nothing reads any more."""
    for df in dfs:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def text_rows(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (rows + 1, from 0) and the bytes of a string column."""
    arr = batch.column(batch.schema.get_field_index(name))
    return bytes_of(arr.fill_null("") if arr.null_count else arr)


def bytes_of(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (items + 1, from 0) and the bytes of a string or binary array without nulls."""
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    _, off, data = arr.buffers()
    kind = np.int64 if wide else np.int32
    if len(arr) == 0 or off is None:
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(off, kind, len(arr) + 1, arr.offset * kind().itemsize).astype(np.int64)
    if data is None:
        return np.zeros(len(arr) + 1, np.int64), np.zeros(0, np.uint8)
    first, last = int(offsets[0]), int(offsets[-1])
    return offsets - first, np.frombuffer(data, np.uint8)[first:last]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


def words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word, and the mask of bytes in words. No word crosses rows."""
    inside = ~SPACE[data]
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), inside
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    heads, tails = offsets[:-1], offsets[1:] - 1
    heads, tails = heads[offsets[1:] > offsets[:-1]], tails[offsets[1:] > offsets[:-1]]
    start[heads] = inside[heads]
    end[tails] = inside[tails]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1, inside


def encode_words(data: np.ndarray, inside: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of the words, and the dictionary (exact, not hashed)."""
    return encode_spans(data[inside], e - s)


def encode_spans(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Dictionary codes of adjoining spans of a byte buffer."""
    off = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=off[1:])
    wide = off[-1] >= 2**31 - 1
    off = off if wide else off.astype(np.int32)
    kind = pa.large_binary() if wide else pa.binary()
    arr = pa.Array.from_buffers(kind, len(lengths), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))])
    d = arr.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[0]..+lengths[0], starts[1]..+lengths[1], ..., as one array."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    full = lengths > 0
    s, n = starts[full], lengths[full]
    at = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=at[1:])
    out[at] = s
    out[at[1:]] -= s[:-1] + n[:-1] - 1
    return np.cumsum(out, out=out)


def per_row(rows: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Sums (or counts) by row number, exact for integers."""
    if weights is None:
        return np.bincount(rows, minlength=n).astype(np.int64)
    return np.rint(np.bincount(rows, weights=weights.astype(np.float64), minlength=n)).astype(np.int64)


def trim() -> None:
    """Gives freed memory back: Python workers outlive their tasks and share the executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow, with what a task leaves behind given back when it ends."""

    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            trim()

    return df.mapInArrow(trimmed, schema)


def map_text(
    df: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]], schema: str, keep: list[str], text: str = "text"
) -> DataFrame:
    """One output row for each input row: the columns keep, then kernel's, which gets offsets and bytes."""
    names = [part.split()[0] for part in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_rows(batch, text)
            for a, b in blocks(offsets):
                got = kernel(offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]])
                cols = [batch.column(batch.schema.get_field_index(k)).slice(a, b - a) for k in keep]
                yield pa.RecordBatch.from_arrays([*cols, *(got[k] for k in names)], names=[*keep, *names])

    src = df.select(*keep, *([] if text in keep else [text]))
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}
    return map_arrow(src, run, ", ".join([*(f"`{k}` {types[k]}" for k in keep), schema]))


def code_points(data: np.ndarray) -> np.ndarray:
    """Mask of bytes that begin a code point."""
    return (data & 0xC0) != 0x80


def cast_text(df: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The columns keep and text alone, under these names; other columns cannot clash with what an operator adds."""
    words = F.col(f"`{text}`").cast("string").alias("text")
    cols = [words if k == "text" else F.col(f"`{k}`") for k in keep]
    return df.select(*cols, *([] if "text" in keep else [words]))


def packed(df: DataFrame) -> DataFrame:
    """_row, a struct of all columns but text, beside text: rows carried through an operator that adds columns."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "text"]).alias("_row"), "text")


def unpacked(df: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    """The columns of packed() rows, some of them replaced."""
    return df.select(*[new[c].alias(c) if c in new else F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns])

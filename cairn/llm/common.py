"""What the operators of this subpackage share: reading, materialising, block-wise text handling."""

from __future__ import annotations

import ctypes
import functools
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one block of a vectorised kernel holds; bounds a Python worker's memory.
BLOCK_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). In local mode, as in tests, one of our own where the session names none; on a cluster that is an error."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(named)
    return named


def materialise(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table in the shared folder and read it back (a lost executor loses nothing).

    A table rather than checkpoint(), whose plans keep the constraints of what they replace, which grow
    exponentially over the rounds of an iteration; a table also tells the optimizer its size.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairn-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cairn_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialised tables that no plan needs any more."""
    for df in tables:
        if path := getattr(df, "_cairn_path", None):
            spark = df.sparkSession
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def finished(result: DataFrame, *tables: DataFrame) -> DataFrame:
    """The result as a table of its own, and the larger tables that it came from deleted."""
    out = materialise(result)
    discard(*tables)
    return out


def release() -> None:
    """Give back to the system what this worker has freed; a reused worker otherwise keeps the most that any of its tasks held."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


def lean(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow whose worker holds no memory beyond its task."""

    @functools.wraps(run)
    def task(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            release()

    return task


def fold(doc_id: Column | str) -> Column:
    """crc32(doc_id as text) mod 3; fold 1 is held out everywhere (null: fold 0)."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string")) % 3, F.lit(0))


def held_out(doc_id: Column | str) -> Column:
    return fold(doc_id) == 1


def unit_hash(*cols: Column | str) -> Column:
    """A deterministic value in [0, 1) from the columns."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def blocks(batches: Iterable[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches into runs of rows with about `limit` bytes of text; never cuts a row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start, done = 0, 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(size, done + limit, side="right")))
            yield batch.slice(start, end - start)
            start, done = end, int(size[end - 1])


def byte_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column (null: empty) as one uint8 array, and each row's offsets in it."""
    col = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if col.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def as_large(column: pa.Array) -> pa.Array:
    """Text with null as the empty string, with 64-bit offsets that start at 0 (string kernels of Arrow misread slices)."""
    data, off = byte_buffer(column)
    return pa.LargeStringArray.from_buffers(len(off) - 1, pa.py_buffer(off), pa.py_buffer(data))


def word_codes(column: pa.Array, lower: bool = False) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of whole texts: codes of all words in order, the distinct words, and each row's word offsets."""
    col = as_large(column)
    lists = pc.ascii_split_whitespace(pc.ascii_lower(col) if lower else col)
    flat, off = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    keep = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    off = np.concatenate(([0], np.cumsum(keep)))[off]
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary, off


def hash_words(words: pa.Array, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each distinct word."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w, seed) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on all bits."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def segment_sum(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of the runs that `off` delimits; empty runs give 0."""
    total = np.concatenate((np.zeros(1, np.float64 if values.dtype.kind == "f" else np.int64), np.cumsum(values, dtype=np.float64 if values.dtype.kind == "f" else np.int64)))
    return total[off[1:]] - total[off[:-1]]


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """One-dimensional arrays as bytes: per array a letter for its type and its length, then all items; compressed where that pays."""
    head = bytes([len(arrays)]) + b"".join(a.dtype.str[1:].encode().ljust(3) + len(a).to_bytes(8, "little") for a in arrays)
    raw = head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)
    if len(raw) < 300:
        return b"-" + raw
    import zstandard

    return b"z" + zstandard.compress(raw, 3)


def unpack_arrays(raw: bytes) -> list[np.ndarray]:
    """The arrays of pack_arrays, read-only."""
    kind, raw = raw[:1], raw[1:]
    if kind == b"z":
        import zstandard

        raw = zstandard.decompress(raw)
    n, out = raw[0], []
    at = 1 + 11 * n
    for k in range(n):
        dtype = np.dtype(raw[1 + 11 * k : 4 + 11 * k].decode().strip())
        size = int.from_bytes(raw[4 + 11 * k : 12 + 11 * k], "little")
        out.append(np.frombuffer(raw, dtype, size, at))
        at += size * dtype.itemsize
    return out

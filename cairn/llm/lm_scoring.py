"""Language-model scoring by cross-entropy difference.

Two n-gram models of the same order, vocabulary (bytes) and smoothing are counted: a target model over the
documents labelled good outside the held-out fold, and a background model over all documents. A document's
score is the mean over its bytes of the background's loss less the target's (bits), so what reads like the
target and unlike the rest scores high. Counts are exact, one for each n-gram that occurs, from every byte of
every document; a context's count is the sum over what follows it, so no probability passes 1:

1. Documents are packed into compressed blocks of text, written to the shared folder. Labels meet the blocks'
   doc_ids, not their texts; the plan is the same at every size.
2. Each block sends its distinct n-grams with their counts to slices, dealt by a hash of the context.
3. A slice adds up the counts of its n-grams and contexts over all blocks, and answers each block with the
   totals of the n-grams that the block sent. The number of slices grows with the input.
4. A block meets its answers, and its documents are scored. No table of counts is in one place.

Nulls: a null text has no tokens and scores 0, as does an empty one; null labels and labels without a document
are ignored, and a repeated label keeps its highest quality; rows with a null doc_id are background only. With
no target text the target model equals the background and every score is 0. Repeated rows count and score as
often as they occur. A very long text is a block of its own, held in one task. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_buffer, finished, held_out, lean, materialise, mix, pack_arrays, release, segment_sum, unpack_arrays

#: Bytes of text in a block and for each slice of the counts, and the fewest slices.
TEXT_BYTES, SLICE_BYTES, SLICES, DISCOUNT = 8 << 20, 8 << 20, 64, 4.0
#: Set in the key of a 3-gram; a key without its lowest byte is its context's.
LOW = np.uint64(1 << 48)
BYTE = np.uint64(8)


def grams(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct 5-grams, sorted, and for each byte the place of the one that it ends. A text is preceded by zero bytes."""
    key, pos = data.astype(np.uint64), np.arange(len(data)) - np.repeat(off[:-1], np.diff(off))
    for k in range(1, 5):
        key[k:] |= np.where(pos[k:] < k, 0, data[:-k]).astype(np.uint64) << np.uint64(8 * k)
    coded = pa.array(key).dictionary_encode()
    kinds = coded.dictionary.to_numpy(zero_copy_only=False)
    order = np.argsort(kinds)
    place = np.empty(len(kinds), np.int64)
    place[order] = np.arange(len(kinds))
    return kinds[order], place[coded.indices.to_numpy(zero_copy_only=False)]


def lower(five: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of the distinct 3-grams that the 5-grams end with, and the place of each one's."""
    return np.unique(five & np.uint64(0xFFFFFF) | LOW, return_inverse=True)


def dealt(keys: np.ndarray, slices: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order of their slices, and where each slice's begin; those of one context share a slice."""
    to = (mix(keys >> BYTE) % np.uint64(slices)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(slices + 1))


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of (n-gram, counts in each model), repeated -> distinct n-grams, and (counts, counts of their contexts) over all rows."""

    def add(inverse: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(inverse, x[:, k], n) for k in range(x.shape[1])], 1).astype(np.int64)  # sums below 2^53 are exact

    kinds, inverse = np.unique(keys, return_inverse=True)
    own = add(inverse, counts, len(kinds))
    contexts, of = np.unique(kinds >> BYTE, return_inverse=True)
    return kinds, np.concatenate((own, add(of, own, len(contexts))[of]), 1)


def losses(n: np.ndarray, context: np.ndarray, n_low: np.ndarray, context_low: np.ndarray) -> np.ndarray:
    """Bits: 5-grams backed off to 3-grams, backed off to a uniform byte."""
    low = (n_low + DISCOUNT / 256) / (context_low + DISCOUNT)
    return -np.log2((n + DISCOUNT * low) / (context + DISCOUNT))


def narrow(counts: np.ndarray) -> list[np.ndarray]:
    """The columns of a table of counts, each in the smallest type that holds it."""
    return [x.astype(np.min_scalar_type(int(x.max(initial=0)))) for x in counts.T]


def _texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents -> blocks, each a row."""
    from pyspark import TaskContext

    at = TaskContext.get().partitionId() << 32
    for b in blocks(batches, "text", TEXT_BYTES):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_batch(b)
        _, off = byte_buffer(b.column("text"))
        ids, sizes = (pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), x) for x in (b.column("doc_id"), pa.array(np.diff(off))))
        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([int(off[-1])], pa.int64()), ids, sizes, pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "n_bytes", "ids", "sizes", "texts"])
        at += 1


def _open(raw: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(raw).read_next_batch()


def score_by_models(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_tokens, loss_target, loss_background (bits a token), score, their difference, and held_out (never in the target)."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    packed = materialise(text.mapInArrow(lean(_texts), "block long, n_bytes long, ids array<long>, sizes array<long>, texts binary"))
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality")).where("quality = 1").where(~held_out("doc_id")).select("doc_id")
    members = packed.select("block", F.posexplode(F.arrays_zip("ids", "sizes")).alias("place", "of")).select("block", "place", F.col("of.ids").alias("doc_id"), F.col("of.sizes").alias("size"))
    targets = materialise(members.join(good, "doc_id").groupBy("block").agg(F.collect_list("place").alias("places"), F.sum("size").alias("n_target")))
    size = packed.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    taught = targets.agg(F.coalesce(F.sum("n_target"), F.lit(0))).first()[0]
    slices = max(SLICES, -(-size // SLICE_BYTES))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        sent: list[tuple[int, int, bytes]] = []
        for block, raw in zip(left.column("block").to_pylist(), left.column("texts"), strict=True):
            b = _open(raw.as_buffer())
            data, off = byte_buffer(b.column("text"))
            five, at = grams(data, off)
            if not len(five):
                continue
            target = np.zeros(b.num_rows, bool)
            target[np.array([x for row in right.column("places").to_pylist() for x in row], np.int64)] = True
            n = np.stack([np.bincount(at, minlength=len(five)), np.bincount(at[np.repeat(target, np.diff(off))], minlength=len(five))], 1)
            three, of = lower(five)
            low = np.stack([np.bincount(of, n[:, k], len(three)).astype(np.int64) for k in range(2)], 1)
            keys, n = np.concatenate((five, three)), np.concatenate((n, low))
            order, cut = dealt(keys, slices)
            for k in np.flatnonzero(np.diff(cut)).tolist():
                m = order[cut[k] : cut[k + 1]]
                sent.append((k, block, pack_arrays(keys[m], *narrow(n[m]))))
        release()
        return pa.table([pa.array([x[i] for x in sent], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["slice", "block", "sent"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sent = [], []
        for b in batches:
            block += b.column("block").to_pylist()
            sent += [unpack_arrays(x) for x in b.column("sent").to_pylist()]
        kinds, found = totals(np.concatenate([x[0] for x in sent]), np.concatenate([np.stack(x[1:], 1).astype(np.int64) for x in sent]))
        for k, (keys, *_) in zip(block, sent, strict=True):
            yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([k], pa.int64()), pa.array([pack_arrays(*narrow(found[np.searchsorted(kinds, keys)]))], pa.binary())], names=["slice", "block", "found"])
        release()

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for raw in left.column("texts"):
            b = _open(raw.as_buffer())
            data, off = byte_buffer(b.column("text"))
            n = np.diff(off)
            five, at = grams(data, off)
            three, of = lower(five)
            order, cut = dealt(np.concatenate((five, three)), slices)
            found = np.zeros((len(order), 4), np.int64)
            for k, x in zip(right.column("slice").to_pylist(), right.column("found").to_pylist(), strict=True):
                found[order[cut[k] : cut[k + 1]]] = np.stack(unpack_arrays(x), 1)
            high, low = found[: len(five)], found[len(five) :][of]
            lb, lt = (losses(high[:, k], high[:, k + 2], low[:, k], low[:, k + 2]) for k in (0, 1 if taught else 0))
            lt, lb = (segment_sum(x[at], off) / np.maximum(n, 1) for x in (lt, lb))
            out.append(pa.Table.from_arrays([b.column("doc_id"), pa.array(n), pa.array(lt), pa.array(lb), pa.array(lb - lt)], names=["doc_id", "n_tokens", "loss_target", "loss_background", "score"]))
        release()
        return pa.concat_tables(out)

    texts = packed.select("block", "texts").groupBy("block")
    found = texts.cogroup(targets.groupBy("block")).applyInArrow(count, "slice long, block long, sent binary").groupBy("slice").applyInArrow(add, "slice long, block long, found binary")
    kind = "doc_id long, n_tokens long, loss_target double, loss_background double, score double"
    scored = texts.cogroup(found.groupBy("block")).applyInArrow(score, kind)
    return finished(scored.withColumn("held_out", held_out("doc_id")), packed, targets)

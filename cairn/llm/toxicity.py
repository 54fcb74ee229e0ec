"""Toxicity: a factorization machine over hashed terms.

Score = logistic(b + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j) with x_i = 1 when a term of bucket i is in
the text. The pairwise part catches what additive weights miss (an insult that counts only beside a
mention of a group). Terms are lower-cased words stripped of punctuation, hashed to `BUCKETS` buckets.

The fit uses a bounded sample of labelled rows outside the held-out fold (`MAX_ROWS` documents, chosen by
hash of doc_id) and every term that is common in it or occurs there significantly more in one class; the others
weigh nothing. Scoring covers every whole text.

Nulls: a null text is empty and scores as the bias alone; null labels are ignored; a repeated label
keeps its highest value; without both classes in the sample every score is the smoothed base rate.
Ties and repeated rows get equal scores. A very long text is held whole in one task. An empty table gives no
rows. Further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, hash_words, held_out, lean, unit_hash, word_codes

BUCKETS, MAX_ROWS, FACTORS, EPOCHS, BATCH = 1 << 20, 12_000, 8, 14, 128
#: A term is learned if at least so many documents of the sample have it and its log odds differ between the classes by so
#: many standard errors, or such a share of the documents has it; others would only be learned by heart.
MIN_DOCS, MIN_Z, MIN_SHARE = 3, 2.5, 0.05
THRESHOLD = 0.7


def terms(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text, flat, and offsets."""
    codes, words, off = word_codes(text, lower=True)
    n = len(off) - 1
    bare = pc.utf8_trim(words, characters=".,;:!?\"'()[]{}*#$%&|<>-_")
    bucket = (hash_words(bare, 8) % np.uint64(BUCKETS)).astype(np.int64)
    bucket[pc.equal(pc.binary_length(bare), 0).to_numpy(zero_copy_only=False)] = -1
    row = np.repeat(np.arange(n), np.diff(off))
    b = bucket[codes] if len(codes) else np.zeros(0, np.int64)
    key = np.unique(row[b >= 0] * BUCKETS + b[b >= 0])
    return key % BUCKETS, np.searchsorted(key, np.arange(n + 1) * BUCKETS)


class Machine:
    """Weights of the chosen buckets; `slot` maps a bucket to its weights (slot 0: none)."""

    def __init__(self, chosen: np.ndarray, bias: float):
        self.chosen, self.bias = np.sort(chosen), bias
        self.w, self.v = np.zeros(len(chosen) + 1), np.zeros((len(chosen) + 1, FACTORS))

    def slots(self, bucket: np.ndarray) -> np.ndarray:
        if not len(self.chosen):
            return np.zeros(len(bucket), np.int64)
        at = np.minimum(np.searchsorted(self.chosen, bucket), len(self.chosen) - 1)
        return np.where(self.chosen[at] == bucket, at + 1, 0)

    def raw(self, slot: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        linear = np.bincount(row, self.w[slot], minlength=n)
        total = np.stack([np.bincount(row, self.v[slot, f], minlength=n) for f in range(FACTORS)], 1)
        square = np.bincount(row, (self.v[slot] ** 2).sum(1), minlength=n)
        return self.bias + linear + 0.5 * ((total**2).sum(1) - square), total

    def score(self, bucket: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        slot, row = self.slots(bucket), np.repeat(np.arange(n), np.diff(off))
        return 1 / (1 + np.exp(-np.clip(self.raw(slot[slot > 0], row[slot > 0], n)[0], -60, 60)))


def train(bucket: np.ndarray, off: np.ndarray, y: np.ndarray, seed: int = 7) -> Machine:
    """Adam on mini-batches with L2, each step over the buckets of its batch alone; deterministic given the sample's order."""
    n, rng = len(y), np.random.default_rng(seed)
    base = (y.sum() + 1) / (n + 2)
    bias = float(np.log(base / (1 - base)))
    if not 0 < y.sum() < n:
        return Machine(np.zeros(0, np.int64), bias)
    kinds, inverse, seen = np.unique(bucket, return_inverse=True, return_counts=True)
    pos = np.bincount(inverse, y[np.repeat(np.arange(n), np.diff(off))])
    odds = np.log((pos + 0.5) / (y.sum() + 1)) - np.log((seen - pos + 0.5) / (n - y.sum() + 1))
    z = np.abs(odds) / np.sqrt(1 / (pos + 0.5) + 1 / (seen - pos + 0.5))
    m = Machine(kinds[(seen >= MIN_DOCS) & ((z >= MIN_Z) | (seen >= MIN_SHARE * n))], bias)
    slot = m.slots(bucket)
    off = np.concatenate(([0], np.cumsum(slot > 0)))[off]
    slot = slot[slot > 0]
    m.v[1:] = rng.normal(0, 0.02, m.v[1:].shape)
    weight = np.concatenate((m.w[:, None], m.v), 1)
    first, second, decay = np.zeros_like(weight), np.zeros_like(weight), np.array([2e-5] + [2e-4] * FACTORS)
    steps = max(1, n // BATCH)
    for epoch in range(EPOCHS):
        rate = 0.03 * (1 - epoch / EPOCHS) + 1e-3
        for k, batch in enumerate(np.array_split(rng.permutation(n), steps)):
            size = off[batch + 1] - off[batch]
            at = np.repeat(off[batch] - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
            kinds, s = np.unique(slot[at], return_inverse=True)
            r, w = np.repeat(np.arange(len(batch)), size), weight[kinds]
            v = w[s, 1:]
            total = np.add.reduceat(np.concatenate((v, np.zeros((1, FACTORS)))), np.minimum(np.cumsum(size) - size, len(v)), axis=0)
            total[size == 0] = 0
            square = np.bincount(r, (v**2).sum(1), minlength=len(batch))
            f = m.bias + np.bincount(r, w[s, 0], minlength=len(batch)) + 0.5 * ((total**2).sum(1) - square)
            g = (1 / (1 + np.exp(-np.clip(f, -60, 60))) - y[batch]) / len(batch)
            part = np.concatenate((g[r][:, None], g[r][:, None] * (total[r] - v)), 1)
            order = np.argsort(s, kind="stable")
            grad = np.add.reduceat(part[order], np.searchsorted(s[order], np.arange(len(kinds))), axis=0) + decay * w
            step = epoch * steps + k + 1
            a, b = 0.9 * first[kinds] + 0.1 * grad, 0.999 * second[kinds] + 0.001 * grad**2
            first[kinds], second[kinds] = a, b
            weight[kinds] = w - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
            m.bias -= rate * float(g.sum())
    m.w, m.v = weight[:, 0], weight[:, 1:]
    return m


def _as_terms(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text"):
        bucket, off = terms(b.column("text"))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(bucket, pa.int32()))], names=["doc_id", "y", "b"])


def fit(docs: DataFrame, labels: DataFrame) -> Machine:
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).where(~held_out("doc_id"))
    share = min(1.0, MAX_ROWS / max(known.count(), 1))
    chosen = known.where(unit_hash("doc_id") < share).limit(2 * MAX_ROWS)
    # at most 2 * MAX_ROWS ids, so the broadcast is bounded and no text is shuffled
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").mapInArrow(lean(_as_terms), "doc_id bigint, y int, b array<int>").toArrow().sort_by("doc_id")
    lists = rows.column("b").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    off = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))).astype(np.int64)
    return train(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), off, rows.column("y").to_numpy().astype(float))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every document."""
    model = fit(docs, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(model.score(*terms(b.column("text"))))], names=["doc_id", "score"])

    scored = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id bigint, score double")
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))

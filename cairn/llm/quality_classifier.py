"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

One vectorised pass turns every whole text into a short vector of transformed statistics. Per class, a
mean and a covariance are summed over all labelled rows of the learning folds (moments only, so the fit
needs no sample); each covariance is shrunk towards the pooled one and towards a multiple of the identity,
factored once by Cholesky, and a document's score is the logistic of the difference of the two Gaussian
log-densities (Mahalanobis distances by the cached factors, log-determinants from their diagonals).

Nulls: a null text counts as empty; rows with a null or unlabelled id are scored but never learned from;
repeated rows get equal scores; a repeated label keeps its highest quality. With fewer than two rows of
a class every score is 0.5 and predicts 1, so that an unfitted model rejects nothing. Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_buffer, finished, held_out, lean, materialise, segment_sum, word_codes

CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&", "bar": b"|<>", "shout": b"!?", "stop": b".,;:", "line": b"\n", "space": b" \t\x0b\x0c\r"}
FEATURES = ("log_words", "log_word_bytes", "distinct", "adjacent", "top_word", "dup_lines", "long_words", *CLASSES)
#: Shrinkage towards the pooled covariance, then towards the identity; the slope of the logistic.
POOLED, RIDGE, SLOPE = 0.1, 0.02, 0.25


def features(text: pa.Array) -> np.ndarray:
    """One row of transformed statistics per text."""
    data, off = byte_buffer(text)
    n = len(off) - 1
    codes, words, woff = word_codes(text)
    count, size = np.diff(woff), np.maximum(np.diff(off), 1)
    some = np.maximum(count, 1)
    out = np.zeros((n, len(FEATURES)))
    length = np.asarray(pa.compute.binary_length(words).to_numpy(zero_copy_only=False) if len(words) else [], np.int64)
    row = np.repeat(np.arange(n), count)
    word_bytes = segment_sum(length[codes], woff) if len(codes) else np.zeros(n)
    pair = row * max(len(words), 1) + codes
    kinds, times = np.unique(pair, return_counts=True)
    of = kinds // max(len(words), 1)
    distinct = np.bincount(of, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, of, times)
    same = np.zeros(len(codes), np.int64)
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    out[:, 0], out[:, 1] = np.log1p(count), np.log1p(word_bytes / some)
    out[:, 2], out[:, 3], out[:, 4] = distinct / some, np.sqrt(segment_sum(same, woff) / some), np.sqrt(top / some)
    out[:, 5] = np.sqrt(duplicate_lines(data, off))
    out[:, 6] = np.sqrt(segment_sum((length[codes] > 20).astype(np.int64), woff) / some)
    group = np.zeros(256, np.uint8)
    for k, chars in enumerate(CLASSES.values(), 1):
        group[list(chars)] = k
    kind = group[data]
    at = np.flatnonzero(kind)
    table = np.bincount(np.repeat(np.arange(n, dtype=np.int32) * 16, np.diff(off))[at] + kind[at], minlength=n * 16).reshape(-1, 16)[:n]
    out[:, 7:] = np.sqrt(table[:, 1 : 1 + len(CLASSES)] / size[:, None])
    return out


def duplicate_lines(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Share of the lines of each text that equal an earlier line of it."""
    raw, share = data.tobytes(), np.zeros(len(off) - 1)
    for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        lines = raw[a:b].split(b"\n")
        if len(lines) > 1:
            share[i] = 1 - len(set(lines)) / len(lines)
    return share


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and `x`, the statistics of the whole text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["doc_id", "x"])

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id bigint, x array<double>")


class Discriminant:
    """The fitted model: standardisation, and per class a mean, a Cholesky factor's inverse and a log-density offset."""

    def __init__(self, moments: dict[int, tuple[float, np.ndarray, np.ndarray]]):
        self.fitted = all(moments.get(c, (0,))[0] >= 2 for c in (0, 1))
        if not self.fitted:
            return
        total = sum(m[0] for m in moments.values())
        mean = sum(m[1] for m in moments.values()) / total
        var = np.diagonal(sum(m[2] for m in moments.values())) / total - mean**2
        self.mean, self.scale = mean, np.sqrt(np.maximum(var, 1e-8))
        means, covs = {}, {}
        for c, (n, s, ss) in moments.items():
            means[c] = (s / n - mean) / self.scale
            covs[c] = (ss / n - np.outer(s / n, s / n)) / np.outer(self.scale, self.scale)
        pooled = sum(moments[c][0] * covs[c] for c in covs) / total
        self.parts = {}
        for c, cov in covs.items():
            s = (1 - POOLED) * cov + POOLED * pooled
            s = (1 - RIDGE) * s + RIDGE * max(np.trace(s) / len(s), 1e-3) * np.eye(len(s))
            factor = np.linalg.cholesky(s)
            self.parts[c] = means[c], np.linalg.inv(factor), np.log(moments[c][0] / total) - np.log(np.diagonal(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.fitted:
            return np.full(len(x), 0.5)
        z = (x - self.mean) / self.scale
        log = {c: k - 0.5 * (((z - m) @ inv.T) ** 2).sum(1) for c, (m, inv, k) in self.parts.items()}
        return 1 / (1 + np.exp(-np.clip(SLOPE * (log[1] - log[0]), -60, 60)))


def fit(rated: DataFrame, labels: DataFrame) -> Discriminant:
    """Class moments over all labelled rows outside the held-out fold; what reaches the driver is a row per class."""
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(~held_out("doc_id"))
    width = len(FEATURES)

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            x, y = np.array(b.column("x").flatten()).reshape(-1, width), np.array(b.column("quality"))
            for c in np.unique(y):
                v, m = x[y == c], sums.setdefault(int(c), [0.0, np.zeros(width), np.zeros((width, width))])
                m[0], m[1], m[2] = m[0] + len(v), m[1] + v.sum(0), m[2] + v.T @ v
        rows = [(c, k, float(x)) for c, (n, s, ss) in sums.items() for k, x in enumerate([n, *s, *ss.ravel()])]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["c", "k", "v"])

    got = rated.join(known, "doc_id").select("x", F.col("quality").cast("int").alias("quality")).mapInArrow(lean(partial), "c int, k int, v double").groupBy("c", "k").agg(F.sum("v").alias("v")).collect()
    moments = {}
    for c in {r["c"] for r in got if r["c"] in (0, 1)}:
        v = np.zeros(1 + width + width * width)
        for r in got:
            if r["c"] == c:
                v[r["k"]] = r["v"]
        moments[c] = v[0], v[1 : 1 + width], v[1 + width :].reshape(width, width)
    return Discriminant(moments)


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (higher: better) and predicted for every document."""
    rated = materialise(with_features(docs))
    model = fit(rated, labels)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = model.score(np.array(b.column("x").flatten()).reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = rated.mapInArrow(lean(run), "doc_id bigint, score double")
    scored = finished(scored, rated)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))

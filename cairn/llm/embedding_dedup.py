"""Near-duplicate embeddings by product quantisation with an inverted index.

Equal vectors collapse to one with a multiplicity. For each dimension that occurs, a coarse quantiser (k-means
on a bounded sample) gives inverted lists; a vector's residual to its list's centroid is coded by
sub-quantisers, one codeword per subspace. Every vector is indexed in its nearest list. As a query it probes
its nearest lists, less those too far from it to hold a neighbour: the inner product with each code is the sum
of table look-ups, and the pairs that may reach the threshold given that code's known residual error, and no
others, are reranked by the exact cosine in double precision. How many lists are probed is measured: sampled
vectors are moved to a cosine of just the threshold, and so many probes are taken that `RECALL` of these pairs
meet from one end or the other. Within a probed list nothing is missed.

Lists are cut into blocks of `BLOCK` and the queries of a list into parts of `ASKS`, and each pair of these is a
task's work, so a dense region is spread over many tasks; a task returns counts per vector and a spanning set of
its links, never all pairs. A pair that both ends find counts once.

Nulls: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different dimensions do not link. Vectors are scaled before their norm is taken, so that none overflows. A null
vec_id links with nothing and has a null component. Rows repeating a vec_id with one vector count as copies.
Equal vectors of many ids are one vector. An empty table gives no rows. Labels and further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import finished, lean, materialise, release, unit_hash
from .components import components

THRESHOLD, RECALL, BLOCK, ASKS, SAMPLE = 0.95, 0.99, 1024, 16_384, 20_000
#: Vectors a list and the most lists (so many centroids are sent to every task); sub-quantisers and codewords of each.
PER_LIST, MAX_LISTS, SUBSPACES, CODEWORDS = 512, 65_536, 8, 64


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = nearest(x, c, 1)[:, 0]
        size = np.bincount(near, minlength=len(c))
        s = np.zeros_like(c)
        np.add.at(s, near, x)
        c[size > 0] = s[size > 0] / size[size > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """The k nearest rows of c for each row of x, nearest first."""
    out = []
    for i in range(0, len(x), 4096):
        d = (c**2).sum(1)[None, :] - 2 * x[i : i + 4096] @ c.T
        p = np.argpartition(d, min(k, len(c)) - 1, axis=1)[:, :k] if k < len(c) else np.broadcast_to(np.arange(len(c)), d.shape)
        out.append(np.take_along_axis(p, np.argsort(np.take_along_axis(d, p, 1), 1, kind="stable"), 1))
    return np.concatenate(out) if out else np.zeros((0, min(k, len(c))), np.int64)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Coarse centroids, the residuals' codebooks, and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float):
        x = unit(sample)
        self.centroids = kmeans(x, lists, 1)
        rest = x - self.centroids[nearest(x, self.centroids, 1)[:, 0]]
        self.cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
        self.books = [kmeans(np.ascontiguousarray(rest[:, c]), CODEWORDS, 2 + i) for i, c in enumerate(self.cuts)]
        self.reach = 2 * np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
        self.probes = self.measure(x[:2000], threshold)

    def measure(self, x: np.ndarray, threshold: float) -> int:
        """So many probes that RECALL of the pairs of a vector and one at the threshold from it meet."""
        k = len(self.centroids)
        if k == 1 or x.shape[1] == 1:
            return k
        w = np.random.default_rng(99).normal(size=x.shape)
        w -= (w * x).sum(1, keepdims=True) * x
        y = threshold * x + np.sqrt(max(0.0, 1 - threshold**2)) * unit(w)
        near_x, near_y = nearest(x, self.centroids, k), nearest(y, self.centroids, k)
        rank = np.minimum((near_x == near_y[:, :1]).argmax(1), (near_y == near_x[:, :1]).argmax(1))
        return int(min(k, max(8, np.quantile(rank, RECALL) + 2)))

    def near(self, x: np.ndarray) -> np.ndarray:
        """The lists to probe, home first; -1 for those too far to hold a neighbour."""
        found = nearest(x, self.centroids, self.probes)
        far = np.linalg.norm(x[:, None, :] - self.centroids[found], axis=2)
        return np.where(far <= far[:, :1] + self.reach, found, -1)

    def encode(self, x: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the residuals to the home lists, and how far each is from its code."""
        rest = x - self.centroids[home]
        codes = np.stack([nearest(rest[:, c], b, 1)[:, 0] for c, b in zip(self.cuts, self.books, strict=True)], 1).astype(np.uint8)
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return codes, np.linalg.norm(rest - decoded, axis=1) + 1e-9

    def approximate(self, q: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric inner products of queries with codes of one list: a table look-up per subspace."""
        out = np.repeat((q @ self.centroids[home])[:, None], len(codes), 1)
        for i, (c, b) in enumerate(zip(self.cuts, self.books, strict=True)):
            out += (q[:, c] @ b.T)[:, codes[:, i]]
        return out


def rerank(q: np.ndarray, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact cosines of the pairs (a, b), pair by pair."""
    return np.concatenate([np.einsum("ij,ij->i", q[a[i : i + 65_536]], x[b[i : i + 65_536]]) for i in range(0, len(a), 65_536)])


def search_block(index: Index, home: int, xs: dict, qs: dict, threshold: float) -> tuple[dict, list]:
    """Weighted link counts by id and a spanning set of the links between queries and one block of a list.

    xs, qs: id, m (copies), x (unit vectors); of xs also codes, slack and probes, of qs also home.
    """
    n_q, n_x = np.zeros(len(qs["id"]), np.int64), np.zeros(len(xs["id"]), np.int64)
    up: dict[int, int] = {}

    def find(v: int) -> int:
        up.setdefault(v, v)
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    links = []
    for i in range(0, len(qs["id"]), 256):
        part, qid = qs["x"][i : i + 256], qs["id"][i : i + 256]
        a, b = np.nonzero((index.approximate(part, home, xs["codes"]) >= threshold - xs["slack"][None, :]) & (qid[:, None] != xs["id"][None, :]))
        # the end of the smaller id finds the pair; the other one only where that end does not probe its list
        mine = (qid[a] < xs["id"][b]) | ~(xs["probes"][b] == qs["home"][i + a][:, None]).any(1)
        a, b = a[mine], b[mine]
        if not len(a):
            continue
        exact = rerank(part, xs["x"], a, b)
        a, b = a[exact >= threshold] + i, b[exact >= threshold]
        np.add.at(n_q, a, xs["m"][b])
        np.add.at(n_x, b, qs["m"][a])
        for u, v in zip(qs["id"][a].tolist(), xs["id"][b].tolist(), strict=True):
            r, t = find(u), find(v)
            if r != t:
                up[max(r, t)] = min(r, t)
                links.append((u, v))
    counts: dict[int, int] = {}
    for ids, n in ((qs["id"], n_q), (xs["id"], n_x)):
        for v, k in zip(ids[n > 0].tolist(), n[n > 0].tolist(), strict=True):
            counts[v] = counts.get(v, 0) + k
    return counts, links


PLACED = "rep long, m long, dim int, vec binary, code binary, slack double, near array<long>"


def indexes(reps: DataFrame, threshold: float) -> dict[int, Index]:
    """An index for each dimension, from a sample of at least SAMPLE or 16 vectors a list, and at most about twice that."""
    counts = {r["d"]: r["n"] for r in reps.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    lists = {d: int(min(MAX_LISTS, max(1, n // PER_LIST))) for d, n in counts.items()}
    want = {d: max(SAMPLE, 16 * k) for d, k in lists.items()}
    share = F.create_map(*(F.lit(x) for d, n in counts.items() for x in (d, min(1.0, 1.5 * want[d] / n))))
    taken: dict[int, list] = {}
    for r in reps.where(unit_hash("rep") < F.element_at(share, F.size("e"))).select("rep", "e").toLocalIterator():
        taken.setdefault(len(r["e"]), []).append((r["rep"], r["e"]))
    return {d: Index(np.array([e for _, e in sorted(rows)[: 2 * want[d]]]), lists[d], threshold) for d, rows in taken.items()}


def near_embeddings(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector."""
    spark = vectors.sparkSession
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("e", lambda x: x != 0)
    v = v.withColumn("fine", F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.coalesce(fine, F.lit(False)))
    # a vector's key: 128 bits of hash, so that no vector is shuffled more than once to find its equals
    good = v.where("fine").withColumns({"h": F.xxhash64("e"), "g": F.xxhash64(F.lit(1), "e", F.lit(2))})
    reps = materialise(good.groupBy("h", "g").agg(F.min("vec_id").alias("rep"), F.count("*").alias("m"), F.first("e").alias("e")))
    index = spark.sparkContext.broadcast(indexes(reps, threshold))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                batch = whole.slice(i, 2048)
                size = pa.compute.list_value_length(batch.column("e")).to_numpy()
                for d in np.unique(size).tolist():
                    b = batch.filter(pa.array(size == d))
                    x = np.array(b.column("e").flatten()).reshape(-1, d)
                    near = index.value[d].near(unit(x))
                    codes, slack = index.value[d].encode(unit(x), near[:, 0])
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, near.size + 1, near.shape[1]), pa.int32()), pa.array(near.ravel().astype(np.int64)))
                    yield pa.RecordBatch.from_arrays([b.column("rep"), b.column("m"), pa.array(np.full(len(x), d, np.int32)), pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in codes], pa.binary()), pa.array(slack), lists], names=["rep", "m", "dim", "vec", "code", "slack", "near"])

    placed = materialise(reps.select("rep", "m", "e").mapInArrow(lean(place), PLACED))
    asked = placed.select("rep", "dim", F.explode(F.array_distinct("near")).alias("list")).where("list >= 0")
    homes = placed.select("dim", F.get("near", F.lit(0)).alias("list")).groupBy("dim", "list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    grid = homes.join(asked.groupBy("dim", "list").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("parts")), ["dim", "list"])
    own = placed.withColumn("list", F.get("near", F.lit(0))).join(F.broadcast(grid), ["dim", "list"])  # grid: a row per list, at most MAX_LISTS a dimension
    own = own.select("dim", "list", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "rep", "m", "vec", "code", "slack", "near")
    asks = placed.withColumn("home", F.get("near", F.lit(0))).withColumn("list", F.explode(F.array_distinct("near"))).where("list >= 0").join(F.broadcast(grid), ["dim", "list"])
    asks = asks.select("dim", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int").alias("part"), "rep", "m", "vec", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("double").alias("slack"), F.array("home").alias("near"))

    def search(key: tuple, table: pa.Table) -> pa.Table:
        d, home = key[0].as_py(), key[1].as_py()
        is_own = table.column("code").is_valid()
        rows = []
        for t in (table.filter(is_own), table.filter(pa.compute.invert(is_own))):
            x = np.frombuffer(b"".join(t.column("vec").to_pylist()), float).reshape(-1, d)
            rows.append({"id": t.column("rep").to_numpy(), "m": t.column("m").to_numpy(), "x": unit(x) if len(x) else x, "near": t.column("near").combine_chunks().flatten().to_numpy().reshape(len(x), -1) if len(x) else None, "t": t})
        xs, qs = rows
        counts, links = {}, []
        if len(xs["id"]) and len(qs["id"]):
            xs |= {"codes": np.frombuffer(b"".join(xs["t"].column("code").to_pylist()), np.uint8).reshape(len(xs["id"]), -1), "slack": xs["t"].column("slack").to_numpy(), "probes": xs["near"]}
            qs["home"] = qs["near"][:, 0]
            counts, links = search_block(index.value[d], home, xs, qs, threshold)
        found = [(a, n, None) for a, n in counts.items()] + [(a, 0, b) for a, b in links]
        release()
        return pa.table([pa.array([r[i] for r in found], pa.int64()) for i in range(3)], names=["a", "n", "b"])

    found = materialise(own.union(asks).groupBy("dim", "list", "block", "part").applyInArrow(search, "a long, n long, b long"))
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    classes = components(found.where("b is not null").select("a", "b"))
    of = reps.select("h", "g", "rep", "m").join(counts, "rep", "left").join(classes.select(F.col("node").alias("rep"), "component"), "rep", "left")
    linked = good.select("vec_id", "h", "g").join(of, ["h", "g"]).select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    bad = v.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.union(bad).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    return finished(out, reps, placed, found, classes)

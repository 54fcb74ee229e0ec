"""Connected components by randomised contraction; no vertex's neighbourhood is ever gathered in one place."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lean, materialise

#: So few edges are finished by union-find in one task; a fixed bound, whatever the input.
SMALL = 200_000


def union_find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (a, b) -> (node, to): the smallest node of each node's component."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        up.setdefault(x, x)
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(a), find(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = np.array(list(up), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.array([find(x) for x in nodes.tolist()], np.int64))], names=["node", "to"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) for every node of the undirected edges (a, b); component is its smallest node.

    Each round draws a random priority per node, points every node at the neighbour (or itself) of smallest
    priority and contracts the edges along those pointers, so a constant share of the remaining nodes goes
    in a round and a hub costs one partially aggregated row per task. Null ends are ignored.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    e = materialise(e.distinct())
    rounds = []
    while e.count() > small:
        rank = lambda c, k=len(rounds): F.struct(F.xxhash64(F.lit(k), F.col(c)).alias("p"), F.col(c).alias("v"))
        both = e.select(F.col("a").alias("node"), rank("b").alias("r"), rank("a").alias("own")).union(e.select(F.col("b"), rank("a"), rank("b")))
        to = materialise(both.groupBy("node").agg(F.least(F.min("r"), F.first("own"))["v"].alias("to")))
        rounds.append(to)
        left = e.join(to.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(to.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = materialise(left.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        discard(e)
        e = left
    roots = materialise(e.coalesce(1).mapInArrow(lean(union_find), "node long, to long"))
    discard(e)
    if not rounds:
        out = roots.withColumnRenamed("to", "component")
        out._cairn_path = roots._cairn_path
        return out
    for to in reversed(rounds):
        last = roots.select(F.col("node").alias("to"), F.col("to").alias("end"))
        out = materialise(to.join(last, "to", "left").select("node", F.coalesce("end", "to").alias("to")))
        discard(to, roots)
        roots = out
    least = roots.groupBy("to").agg(F.min("node").alias("component"))
    out = materialise(roots.join(least, "to").select("node", "component"))
    discard(roots)
    return out

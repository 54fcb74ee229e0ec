"""N-gram Jaccard self-join by T-occurrence search (DivideSkip), exact, as connected classes.

Two documents link when 100 * intersection >= `percent` * union of their sets of `shingle`-word shingles.

1. Every whole text becomes a sorted set of 64-bit shingle hashes. Equal sets are one class; one document
   stands for each.
2. Linked sets differ in at most H shingles, H bounded by their sizes, so when a set is dealt into more than
   H parts by hash, linked sets agree on whole parts. Equal parts among sets of similar size (neighbouring
   bands of sizes) are found by one shuffle of part hashes, and give candidate clusters. Parts made only
   of very common shingles (found in a bounded sample) are left out where enough others must agree too, so
   shared passages do not tie unrelated documents together. Clusters of more than `BLOCK_DOCS` documents are
   taken apart: documents that share too few shingles with all others of theirs go, and the rest is tied anew
   by parts dealt by another hash, as often as that helps.
3. Inside a cluster, inverted lists over the shingles are searched for every document: a set of size a needs
   T = ceil(percent% of a) common shingles; the short lists are merged and counted, and documents that
   reach T less the number of long lists are looked up in the long ones by binary search. Clusters larger
   than `BLOCK_DOCS` are cut into blocks that share a few pivots; what pivots and blocks leave
   unconnected is then searched against the other blocks of its cluster. A document that has too few shingles
   in common with a block's documents taken together is not searched for there. A pair that is connected
   already need not be verified: classes lose no link.

Nulls: a null or wordless text has an empty set and links with nothing; a null doc_id links with nothing and
has a null component. Rows that repeat a doc_id are one document for links, each with its own n_shingles.
Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, discard, finished, hash_words, lean, materialise, mix, unit_hash, word_codes
from .components import components

#: What op3 takes for shingle size and percent; the defaults.
SHINGLE, PERCENT = 4, 85
BLOCK_DOCS, PIVOTS = 256, 4
#: The most times that wide clusters are taken apart, and tasks that a cluster's documents are dealt to where they meet a row of their cluster's.
ROUNDS, SALTS = 4, 32
#: Edges held in a task before they go out, and documents held in a search before it runs.
EDGES, HELD_DOCS = 500_000, 1024
#: Bytes of sets that are worked on at once where rows need not be together.
SET_BYTES = 2 << 20
#: Documents sampled for common shingles, the share of them that makes a shingle common, and the most such shingles kept.
SAMPLE_DOCS, COMMON_SHARE, MAX_COMMON = 20_000, 0.001, 200_000
PRIME = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(text: pa.Array, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, flat, and offsets."""
    codes, words, off = word_codes(text, lower=True)
    n, count = len(off) - 1, np.diff(off)
    h = hash_words(words)[codes] if len(codes) else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), count)
    with np.errstate(over="ignore"):
        full = np.full(len(h), size, np.uint64)
        for k in range(size):
            step = np.zeros(len(h), np.uint64)
            step[: len(h) - k] = h[k:]
            full = mix(full * PRIME + step)
        left = off[1:][row] - np.arange(len(h))  # words from here to the end
        keep = left >= size
        short = np.flatnonzero((count > 0) & (count < size))
        extra = np.zeros(len(short), np.uint64)
        for i, r in enumerate(short):
            x = np.full(1, 1000 + count[r], np.uint64)
            for w in h[off[r] : off[r + 1]]:
                x = mix(x * PRIME + w)
            extra[i] = x[0]
    row, full = np.concatenate((row[keep], short)), np.concatenate((full[keep], extra))
    s = np.lexsort((full, row))
    row, full = row[s], full[s]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (full[1:] != full[:-1])
    row, full = row[new], full[new]
    return full, np.searchsorted(row, np.arange(n + 1))


def fingerprint(flat: np.ndarray, off: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(flat ^ seed), dtype=np.uint64)))
    return mix((total[off[1:]] - total[off[:-1]]) ^ mix(np.diff(off).astype(np.uint64)))


@cache
def band_table(percent: int = PERCENT, top: int = 1 << 40) -> np.ndarray:
    """Lower bounds of the bands of sizes: linked sets lie in one band or in neighbouring ones."""
    low = [1]
    while low[-1] < top:
        low.append(low[-1] * 100 // percent + 1)
    return np.array(low, np.int64)


def parts_of(slot: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Number of parts in a slot (bands `slot` and `slot` + 1) and how many must agree beyond the first."""
    a = band_table(percent)[slot + 1] - 1
    b = a * 100 // percent
    most = (100 - percent) * (a + b) // (100 + percent)
    slack = 1 + most // 16
    return most + 1 + slack, slack


def signatures(flat: np.ndarray, off: np.ndarray, common: np.ndarray, percent: int = PERCENT, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(set, part hash) of the parts by which a set is to be found."""
    n, size = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(n), size)
    band = np.searchsorted(band_table(percent), size, side="right") - 1
    rare = np.ones(len(flat), bool)
    if len(common):
        at = np.minimum(np.searchsorted(common, flat), len(common) - 1)
        rare = common[at] != flat
    sets, keys = [], []
    with np.errstate(over="ignore"):
        for back in (0, 1):
            slot = band - back
            ok = (size > 0) & (slot >= 0)
            parts, slack = parts_of(np.where(ok, slot, 0), percent)
            parts = np.where(ok, parts, 0)
            base = np.concatenate(([0], np.cumsum(parts)))
            live = ok[row]
            r, x = row[live], flat[live]
            cell = base[r] + (mix(x + np.uint64(77 + seed)) % parts[r].astype(np.uint64)).astype(np.int64)
            weight = mix(x ^ np.uint64(0xABCDEF12345))
            both = np.zeros((2, base[-1]), np.uint64)
            np.add.at(both[0], cell, weight)
            use = rare[live]
            strong = np.zeros(base[-1], bool)
            strong[cell[use]] = True
            owner = np.repeat(np.arange(n), parts)
            weak = np.bincount(owner[~strong], minlength=n)
            emit = strong | (weak > slack)[owner]
            part = np.arange(base[-1]) - base[owner]
            key = mix(both[0] ^ mix(slot[owner].astype(np.uint64) * np.uint64(1 << 32) + part.astype(np.uint64)))
            sets.append(owner[emit])
            keys.append(key[emit])
    return np.concatenate(sets), np.concatenate(keys)


def stars(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (key, doc) -> the smallest doc of each key's rows, as an index of rows, and edges to it from the others."""
    s = np.lexsort((doc, key))
    k, d = key[s], doc[s]
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], k[1:] != k[:-1]))[: len(k)], np.arange(len(k)), 0)) if len(k) else np.zeros(0, np.int64)
    other = d != d[lead]
    return s[np.unique(lead)], d[other], d[lead[other]]


KIND = "kind int, key long, a long, b long, n long"
DOC, PART, LINK, SAME = 0, 1, 2, 3


def _rows(*parts: tuple) -> pa.RecordBatch:
    cols = [np.concatenate([np.broadcast_to(np.asarray(p[i]), len(p[2])).astype(np.int64) for p in parts]) for i in range(5)]
    return pa.RecordBatch.from_arrays([pa.array(cols[0].astype(np.int32)), *(pa.array(c) for c in cols[1:])], names=["kind", "key", "a", "b", "n"])


def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (key, kind, n, a): equal parts and equal sets are tied to the first document that has them."""
    last, found, size = (None, None, None, 0), [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        edges = np.unique(np.concatenate(found), axis=0)
        for i in range(0, len(edges), 50_000):
            e = edges[i : i + 50_000]
            yield _rows((e[:, 0], 0, e[:, 1], e[:, 2], 0))

    for batch in batches:
        kind, key, a, c, n = (np.asarray(batch.column(i).to_numpy(zero_copy_only=False)) for i in range(5))
        tie = (kind == PART) | (kind == SAME) & (a == c)
        if not tie.all():
            yield _rows((kind[~tie], 0, a[~tie], c[~tie], n[~tie]))
        kind, key, a, n = kind[tie], key[tie], a[tie], n[tie]
        if not len(key):
            continue
        new = np.concatenate(([(key[0], kind[0], n[0]) != last[:3]], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1]) | (n[1:] != n[:-1])))
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        lead = np.where(at < 0, last[3], a[at])
        last = (key[-1], kind[-1], n[-1], lead[-1])
        other = a != lead
        found.append(np.stack((np.where(kind == PART, LINK, SAME), a, lead), 1)[other].astype(np.int64))
        size += int(other.sum())
        if size > EDGES:
            yield from flush()
            found, size = [], 0
    if size:
        yield from flush()


def met(rows: DataFrame) -> DataFrame:
    """Rows of KIND with equal keys brought together: the ties of equal parts and sets, and all other rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(parts, "key").sortWithinPartitions("key", "kind", "n", "a").mapInArrow(lean(meet), KIND)


def find_candidates(docs: DataFrame, common: np.ndarray, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Rows of KIND: documents (a, n), candidate links and links of equal sets (a, b)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)
            flat, off = shingle_sets(b.column("text"), shingle)
            size = np.diff(off)
            print_, second = (fingerprint(flat, off, np.uint64(k)) for k in (0, 0x5851F42D4C957F2D))
            some = np.flatnonzero(size > 0)
            _, equal = np.unique(np.stack((print_, second), 1)[some], axis=0, return_inverse=True)
            lead, x, y = stars(equal.ravel(), ids[some])
            lead = some[lead]  # one document for each set of this block goes on
            starts = off[lead]
            n = size[lead]
            place = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
            owner, key = signatures(flat[place], np.concatenate(([0], np.cumsum(n))), shared.value, percent)
            first, u, v = stars(key, ids[lead][owner])
            yield _rows(
                (DOC, ids * 31 + size, ids, 0, size), (PART, key[first].view(np.int64), ids[lead][owner[first]], 0, 0),
                (LINK, u, u, v, 0), (SAME, x, x, y, 0), (SAME, print_[lead].view(np.int64), ids[lead], ids[lead], second[lead].view(np.int64)),
            )

    return met(docs.mapInArrow(lean(scan), KIND))


def spread_join(docs: DataFrame, clusters: DataFrame, how: str = "inner") -> DataFrame:
    """Documents with what is known of their clusters; a wide cluster's documents are dealt to `SALTS` tasks."""
    salted = clusters.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return docs.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(salted, ["component", "salt"], how).drop("salt")


def refine(wide: DataFrame, common: np.ndarray, percent: int, seed: int) -> DataFrame:
    """(doc_id, component, shingles) of wide clusters -> the same in narrower ones; no link is lost.

    A document most of whose shingles no other document of its cluster has is linked with nothing. The others are
    tied anew by equal parts, dealt by another hash: chance ties, of documents that share a passage, rarely occur twice.
    """
    shared = wide.sparkSession.sparkContext.broadcast(common)

    def spread(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "shingles", SET_BYTES):
            n = pc.binary_length(b.column("shingles")).to_numpy() // 8
            flat = np.frombuffer(b"".join(b.column("shingles").to_pylist()), np.int64)
            each = [pa.array(np.repeat(b.column(c).to_numpy(), n)) for c in ("component", "doc_id")]
            yield pa.RecordBatch.from_arrays([each[0], pa.array(flat), each[1]], names=["component", "shingle", "doc_id"])

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "shingles", SET_BYTES):
            raw = b.column("shingles").to_pylist()
            off = np.concatenate(([0], np.cumsum([len(x) // 8 for x in raw]))).astype(np.int64)
            owner, key = signatures(np.frombuffer(b"".join(raw), np.uint64), off, shared.value, percent, seed)
            ids, cluster = (b.column(c).to_numpy() for c in ("doc_id", "component"))
            key ^= mix(cluster.astype(np.uint64))[owner]
            first, u, v = stars(key, ids[owner])
            yield _rows((PART, key[first].view(np.int64), ids[owner][first], 0, 0), (LINK, u, u, v, 0))

    alone = wide.mapInArrow(lean(spread), "component long, shingle long, doc_id long").groupBy("component", "shingle").agg(F.count("*").alias("c"), F.min("doc_id").alias("doc_id")).where("c = 1").groupBy("doc_id").agg(F.count("*").alias("alone"))
    size = F.octet_length("shingles") / 8
    alive = materialise(wide.join(alone, "doc_id", "left").where(100 * (size - F.coalesce("alone", F.lit(0))) >= percent * size).select("doc_id", "component", "shingles"))
    label = components(met(alive.mapInArrow(lean(sign), KIND)).select("a", "b"))
    out = materialise(alive.drop("component").join(label.select(F.col("node").alias("doc_id"), "component"), "doc_id").select("doc_id", "component", "shingles"))
    discard(alive, label)
    return out


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of shingles that are common in a bounded sample of documents; only speed hangs on them."""
    n = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(n, 1))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            kinds, times = np.unique(shingle_sets(b.column("text"), shingle)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(times)], names=["h", "n"])

    counts = docs.where(unit_hash("doc_id") < share).mapInArrow(lean(scan), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= max(6, int(COMMON_SHARE * min(n, SAMPLE_DOCS))))
    return np.sort(np.array([r[0] for r in counts.orderBy(F.desc("n"), "h").limit(MAX_COMMON).select("h").collect()], np.int64).view(np.uint64))


class Classes:
    """Union-find over places 0..n-1."""

    def __init__(self, label: np.ndarray):
        _, first, inverse = np.unique(label, return_index=True, return_inverse=True)
        self.up = first[inverse].tolist()

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x


def divide_skip(flat: np.ndarray, off: np.ndarray, label: np.ndarray, query: np.ndarray, percent: int = PERCENT, target: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links (positions of sets) that connect sets of different labels, for the sets marked as queries against the targets (all, if none are given)."""
    size = np.diff(off)
    n = len(size)
    target = np.ones(n, bool) if target is None else target
    row = np.repeat(np.arange(n), size)
    order = np.argsort(size, kind="stable")  # sets in order of size; those of a query's range of sizes are neighbours
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    sizes = size[order]
    held = target[row]
    terms = np.unique(flat[held])
    if not len(terms):
        return []
    lists = np.minimum(np.searchsorted(terms, flat), len(terms) - 1)
    known = terms[lists] == flat
    index = np.sort(lists[held] * n + place[row[held]])  # inverted lists of the targets, one after another
    bounds = np.searchsorted(index, np.arange(len(terms) + 1) * n)
    length = np.diff(bounds)
    # a partner shares `need` shingles, so a query needs as many that some other target has
    shared = known & (length[lists] > held)
    query = query & (size > 0) & (np.bincount(row[shared], minlength=n) >= -(-percent * size // 100))
    classes, found = Classes(label), []
    for q in np.flatnonzero(query)[np.argsort(size[query], kind="stable")].tolist():
        a, mine = int(size[q]), int(place[q])
        low, high = np.searchsorted(sizes, -(-percent * a // 100)), np.searchsorted(sizes, a * 100 // percent, side="right")
        need = -(-percent * a // 100)
        own = lists[off[q] : off[q + 1]][known[off[q] : off[q + 1]]].astype(np.int64)
        own = own[np.argsort(length[own], kind="stable")]
        # of the `need` lists a partner must be on, the longest are looked up and the rest merged
        long_ = min(need - 1, max(0, int(need / (0.02 * np.log2(length[own[-1]] + 1) + 1))))
        short, probe = own[: len(own) - long_], own[len(own) - long_ :]
        merged = np.concatenate([index[bounds[t] : bounds[t + 1]] - t * n for t in short.tolist()]) if len(short) else np.zeros(0, np.int64)
        merged = merged[(merged >= low) & (merged < high) & (merged != mine)]
        if not len(merged):
            continue
        who, count = np.unique(merged, return_counts=True)
        ok = count >= need - long_
        who, count = who[ok], count[ok]
        s = np.argsort(-count, kind="stable")
        who, count = who[s], count[s]
        tries = 4
        while len(who):
            root = classes.find(q)
            there = np.array([classes.find(int(order[w])) for w in who.tolist()])
            open_ = there != root
            who, count, there = who[open_], count[open_], there[open_]
            if not len(who):
                break
            # a few of each class first: one link is enough to join it
            rank = np.empty(len(who), np.int64)
            g = np.argsort(there, kind="stable")
            head = np.maximum.accumulate(np.where(np.concatenate(([True], there[g][1:] != there[g][:-1])), np.arange(len(g)), 0))
            rank[g] = np.arange(len(g)) - head
            now = rank < tries
            w, c = who[now], count[now]
            if len(probe):
                keys = probe[:, None] * n + w[None, :]
                at = np.minimum(np.searchsorted(index, keys), len(index) - 1)
                c = c + (index[at] == keys).sum(0)
            for x in w[(100 + percent) * c >= percent * (a + sizes[w])].tolist():
                other = int(order[x])
                r, t = classes.find(q), classes.find(other)
                if r != t:
                    classes.up[max(r, t)] = min(r, t)
                    found.append((q, other))
            who, count = who[~now], count[~now]
            tries *= 8
    return found


def search_at(percent: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        doc, label, query, target = (t.column(c).to_numpy() for c in ("doc_id", "label", "query", "target"))
        sets = [np.frombuffer(x, np.uint64) for x in t.column("shingles").to_pylist()]
        off = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int64)
        found = divide_skip(np.concatenate(sets), off, label, query.astype(bool), percent, target=target.astype(bool))
        a, b = (np.array([doc[p[i]] for p in found], np.int64) for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def targets(rows: pa.RecordBatch, of: tuple) -> pa.RecordBatch:
        mine = pc.and_(pc.equal(rows.column("component"), pa.scalar(int(of[0]))), pc.equal(rows.column("block"), pa.scalar(int(of[1]), pa.int32())))
        return rows.filter(pc.and_(mine, rows.column("target")))

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(component, block, query, target, doc_id, label, set), in order of the first three -> verified links (a, b).

        Small blocks are searched together, and the queries of a block that has many in turns; what is held is bounded by the members of a block.
        """
        held: list[pa.RecordBatch] = []
        size, load, last = 0, 0, None
        for batch in batches:
            component, block = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("component", "block"))
            bounds = np.flatnonzero(np.concatenate(([True], (component[1:] != component[:-1]) | (block[1:] != block[:-1]))))[: len(component)]
            for i, j in zip(bounds.tolist(), [*bounds[1:].tolist(), len(component)], strict=True):
                now = (component[i], block[i])
                if (size > HELD_DOCS or load > SET_BYTES) and now != last:
                    yield links(held)
                    held, size, load = [], 0, 0
                elif (size > HELD_DOCS or load > SET_BYTES) and not batch.column("target")[i].as_py():
                    yield links(held)  # the targets of this block stay for its further queries
                    held, size, load = [x for x in (targets(h, now) for h in held) if x.num_rows], 0, 0
                held.append(batch.slice(i, j - i))
                size, load = size + j - i, load + (pc.sum(pc.binary_length(held[-1].column("shingles"))).as_py() or 0)
                last = now
        if size:
            yield links(held)

    return search


def sets_at(shingle: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def as_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            flat, off = shingle_sets(b.column("text"), shingle)
            raw = [flat[i:j].tobytes() for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            keep = [c for c in b.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(raw, pa.binary())], names=[*keep, "shingles"])

    return as_sets


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id for every document."""
    search, as_sets = search_at(percent), sets_at(shingle)
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_ = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    d = all_.where("doc_id is not null")
    common = common_shingles(d, shingle)
    rows = materialise(find_candidates(d, common, shingle, percent))
    same = rows.where(F.col("kind") == SAME).select("a", "b")
    cluster = components(rows.where(F.col("kind") == LINK).select("a", "b"))
    # of equal sets one document is searched for
    members = materialise(cluster.join(same.select(F.col("a").alias("node")).distinct(), "node", "left_anti").select(F.col("node").alias("doc_id"), "component"))
    single = members.groupBy("component").agg(F.count("*").alias("m"), F.min("doc_id").alias("doc_id")).where("m = 1").select("doc_id")
    widths = lambda x: x.groupBy("component").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK_DOCS)
    sets = materialise(d.join(members.join(single, "doc_id", "left_anti"), "doc_id").mapInArrow(lean(as_sets), "doc_id long, component long, shingles binary"))
    discard(cluster, members)
    # clusters of more than a block are taken apart as far as that goes
    narrow, left, tables = [], None, [rows, sets]
    for seed in range(1, ROUNDS + 1):
        before, left = left, widths(sets).agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
        if not left or before and left > 0.8 * before:
            break
        wide = widths(sets).select("component")
        narrow.append(spread_join(sets, wide, "left_anti").select("doc_id", "component", "shingles"))
        sets = refine(spread_join(sets, wide).select("doc_id", "component", "shingles"), common, percent, seed)
        tables.append(sets)
    for x in narrow:
        sets = sets.union(x)
    counts = widths(sets).select("component", F.ceil(F.col("m") / BLOCK_DOCS).cast("int").alias("blocks"))
    sets = materialise(spread_join(sets, counts, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")).select("doc_id", "component", "blocks", "block", "shingles"))
    tables.append(sets)
    big = sets.where("blocks > 1")
    chosen = big.groupBy("component").agg(*(F.min(F.struct(F.xxhash64(F.lit(k), "doc_id").alias("h"), "doc_id"))["doc_id"].alias(f"p{k}") for k in range(PIVOTS)))
    chosen = chosen.select("component", F.explode(F.array_distinct(F.array(*(f"p{k}" for k in range(PIVOTS))))).alias("doc_id"))
    pivots = big.join(chosen, ["component", "doc_id"], "left_semi")
    pivots = pivots.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    local = sets.union(pivots.select(sets.columns)).select("doc_id", F.col("doc_id").alias("label"), F.lit(True).alias("query"), F.lit(True).alias("target"), "shingles", "component", "block")
    dealt = lambda x: x.repartition(parts, "component", "block").sortWithinPartitions("component", "block", "query").mapInArrow(lean(search), kind)
    kind = "a long, b long"
    links = materialise(dealt(local).union(same))
    tables.append(links)
    if not big.isEmpty():
        joined = components(links)
        tables.append(joined)
        state = materialise(big.join(joined.select(F.col("node").alias("doc_id"), F.col("component").alias("label")), "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id")))
        tables.append(state)
        # one row per cluster and block meets the members, so that no join puts a whole cluster into one task
        largest = state.groupBy("component", "label").agg(F.count("*").alias("count"), F.max("blocks").alias("blocks")).groupBy("component").agg(F.max(F.struct("count", "label"))["label"].alias("most"), F.max("blocks").alias("blocks"))
        each = lambda x: x.select("component", *(c for c in x.columns if c not in ("component", "blocks")), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        rest = state.join(each(largest), ["component", "block"]).where("label <> most")
        if not rest.isEmpty():
            ask = rest.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            pick = lambda x, ask_: x.select("doc_id", "label", F.lit(ask_).alias("query"), F.lit(not ask_).alias("target"), "shingles", "component", "block")
            touched = state.join(each(rest.select("component", "blocks").distinct()), ["component", "block"], "left_semi")
            more = dealt(pick(touched, False).union(pick(ask, True)))
            more = materialise(more)
            tables.append(more)
            links = links.union(more)
    final = components(links)
    tables.append(final)
    found = rows.where(F.col("kind") == DOC).select(F.col("a").alias("doc_id"), F.col("n").alias("n_shingles"))
    out = found.join(final.select(F.col("node").alias("doc_id"), F.col("component").alias("c")), "doc_id", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    nulls = all_.where("doc_id is null").mapInArrow(lean(as_sets), "doc_id long, shingles binary").select("doc_id", (F.octet_length("shingles") / 8).cast("long").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return finished(out.union(nulls), *tables)

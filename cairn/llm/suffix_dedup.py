"""Suffix-array deduplication of repeated byte strings, exact.

Every byte covered by a `LENGTH`-byte string that also starts earlier (smaller doc_id, or earlier in the same
document) is removed. Windows are the starts of such strings. Sorting the suffix of every window over a
whole corpus would move `LENGTH` times the input, so suffixes are sorted at anchors: the `GRAM`-byte string
of smallest hash in a window is its anchor, equal windows have equal anchors at equal offsets, and runs of
neighbouring windows share one. A run moves once, with the bytes its windows span.

1. A small sample gives splitters over the leading bytes of the anchors' suffixes, and the leading bytes
   so frequent that they would overload a bucket.
2. Each block of documents finds its anchors, drops windows that repeat within the block, and sends every
   run to the bucket of its range. Windows at overloaded anchors go out singly, by 128 bits of a hash of all
   their bytes, and are settled in two steps: among groups of blocks first, then among the groups' first ones.
3. A bucket sorts the suffixes at its anchors by multikey quicksort on 8-byte tokens, and what lies before
   the anchors likewise, backwards. Common-prefix lengths of neighbours then cut, for each offset of the
   anchor, classes of equal windows: equal to the right and to the left. All but a class's first repeat.
   Equal windows never lie in two buckets, so comparing across an anchor replaces comparing across buckets.
4. The spans of a document meet with its text, and what is left is cut out.

Nulls: a null text is empty; a null doc_id sorts first. Rows that repeat a doc_id and a text get the same
result (neither is earlier); rows with one doc_id and different texts are ordered by start alone. Texts
shorter than `LENGTH` stay whole. Very long texts are worked through in segments. An empty table gives no
rows. Further columns are dropped unless named, and their names may be any.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_buffer, lean, mix, pack_arrays, release, unit_hash, unpack_arrays

LENGTH, GRAM = 100, 24
SPAN = LENGTH - GRAM + 1
#: Bytes of text per bucket, the most ranges that splitters make, and the longest piece of a text taken at once.
BUCKET_BYTES, MAX_RANGES, SEGMENT = 6 << 20, 50_000, 2 << 20
BLOCK = 3 << 20
#: Low bits of a window's key that hold its place; texts are taken in groups of no more bytes than that.
PLACE_BITS = 24
PRIME = np.uint64(0x9E3779B97F4A7C15)
RUNS, WINDOWS, SPANS = 0, 1, 2


def rolling(data: np.ndarray) -> np.ndarray:
    """A mixed hash of the GRAM bytes from each position on (positions near the end hash what is there)."""
    h, power, width = data.astype(np.uint64) + np.uint64(1), PRIME, 1
    out, done = np.zeros(len(data), np.uint64), 0
    with np.errstate(over="ignore"):
        while width <= GRAM:
            if GRAM & width:  # GRAM as a sum of powers of two
                out *= power
                out[: len(data) - done] += h[done:]
                done += width
            nxt = h * power
            nxt[:-width] += h[width:]
            h, power, width = nxt, power * power, 2 * width
    h = out
    return mix(h)


def runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: first window, windows, anchor; all as places in `data`. off: the texts' bounds."""
    found, k = [], 0
    while k < len(off) - 1:
        end = int(np.searchsorted(off, off[k] + (1 << PLACE_BITS), side="right")) - 1
        if end <= k:
            raise ValueError(f"a piece of {off[k + 1] - off[k]} bytes has places beyond {PLACE_BITS} bits")
        first, count, anchor = _runs(data[off[k] : off[end]], off[k : end + 1] - off[k])
        found.append((first + off[k], count, anchor + off[k]))
        k = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def _runs(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for texts of at most 2 ** PLACE_BITS bytes together."""
    none = np.zeros(0, np.int64)
    size = np.diff(off)
    if not (size >= LENGTH).any():
        return none, none, none
    low = np.uint64((1 << PLACE_BITS) - 1)
    with np.errstate(over="ignore"):
        key = (rolling(data) & ~low) | np.arange(len(data), dtype=np.uint64)
    width = 1
    while width * 2 <= SPAN:
        key[:-width] = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = SPAN - width
    key[:-rest] = np.minimum(key[:-rest], key[rest:])
    windows = np.maximum(size - LENGTH + 1, 0)
    first = np.repeat(off[:-1] - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    anchor = (key[first] & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1))))
    return first[new], np.diff(np.append(new, len(first))), anchor[new]


def token_matrix(data: np.ndarray, at: np.ndarray, size: np.ndarray, tokens: int, back: bool = False) -> np.ndarray:
    """Big-endian 8-byte tokens of the `size` bytes from `at` on (or before it, backwards); zeros beyond."""
    width = 8 * tokens
    padded = np.concatenate((np.zeros(width, np.uint8), data, np.zeros(width, np.uint8)))
    views = np.lib.stride_tricks.sliding_window_view(padded, width)
    m = views[at] if back else views[at + width]
    if back:
        m = np.ascontiguousarray(m[:, ::-1])
    m[np.arange(width, dtype=np.int16) >= np.asarray(size)[:, None].astype(np.int16)] = 0
    return m.view(">u8").astype(np.uint64)


def multikey_sort(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows, and each row's common prefix with the one before it, in bytes.

    Multikey quicksort level by level: rows are sorted by one token, and only rows that still tie go on to
    the next.
    """
    n, depth = tokens.shape
    order, lcp = np.arange(n), np.full(n, 8 * depth, np.int64)
    if n:
        lcp[0] = 0
    live, group = np.arange(n), np.zeros(n, np.int64)
    for d in range(depth):
        if len(live) < 2:
            break
        t = tokens[order[live], d]
        s = np.lexsort((t, group))
        order[live], t, g = order[live][s], t[s], group[s]
        same = g[1:] == g[:-1]
        differ = same & (t[1:] != t[:-1])
        x = t[1:][differ] ^ t[:-1][differ]
        shared = np.zeros(len(x), np.int64)
        for k in range(1, 8):
            shared += (x >> np.uint64(64 - 8 * k)) == 0
        lcp[live[1:][differ]] = 8 * d + shared
        new = np.concatenate(([True], ~same | differ))
        group = np.cumsum(new)
        tied = ~new | np.concatenate((~new[1:], [False]))
        live, group = live[tied], group[tied]
    return order, lcp


def first_only(key: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> np.ndarray:
    """Which rows, sorted by (doc, pos), come strictly after another row of their key."""
    s = np.argsort(key, kind="stable")
    k = key[s]
    lead = np.maximum.accumulate(np.where(np.concatenate(([True], k[1:] != k[:-1])), np.arange(len(k)), 0))
    later = np.zeros(len(key), bool)
    later[s] = (doc[s] > doc[s[lead]]) | (pos[s] > pos[s[lead]]) & (doc[s] == doc[s[lead]])
    return later


def repeated(data: np.ndarray, first: np.ndarray, count: np.ndarray, anchor: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (run, place of its first byte in `data`) that equal an earlier one. doc, pos: of the runs' first windows in order of documents."""
    none = np.zeros(0, np.int64)
    if len(first) < 2:
        return none, none
    gram = token_matrix(data, anchor, np.full(len(anchor), GRAM), GRAM // 8)
    key = np.zeros(len(anchor), np.uint64)
    with np.errstate(over="ignore"):
        for d in range(gram.shape[1]):
            key = mix(key * PRIME + gram[:, d])
    _, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
    pick = np.flatnonzero(times[inverse] > 1)
    if not len(pick):
        return none, none
    pick = pick[np.lexsort((pos[pick] + anchor[pick] - first[pick], doc[pick]))]
    first, count, anchor, doc = first[pick], count[pick], anchor[pick], doc[pick]
    where = pos[pick] + anchor - first
    right = multikey_sort(token_matrix(data, anchor, first + count - 1 + LENGTH - anchor, -(-LENGTH // 8)))
    left = multikey_sort(token_matrix(data, anchor, anchor - first, -(-(SPAN - 1) // 8), back=True))
    n = len(pick)
    most, least = anchor - first, anchor - first - count + 1
    run, place = [none], [none]
    for j in range(SPAN):
        at = np.flatnonzero((least <= j) & (j <= most))
        if len(at) < 2:
            continue
        cls = []
        for (order, lcp), depth in ((right, LENGTH - j), (left, j)):
            c = np.empty(n, np.int64)
            c[order] = np.cumsum(lcp < depth)
            cls.append(c[at])
        hit = at[first_only(cls[0] * (n + 1) + cls[1], doc[at], where[at])]
        run.append(pick[hit])
        place.append(anchor[hit] - j)
    return np.concatenate(run), np.concatenate(place)


def union(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals, per document."""
    if not len(doc):
        return doc, start, end
    s = np.lexsort((start, doc))
    doc, start, end = doc[s], start[s], end[s]
    new = np.ones(len(doc), bool)
    change = np.concatenate(([True], doc[1:] != doc[:-1]))
    step = np.cumsum(change).astype(np.int64) * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + step)
    new[1:] = (start[1:] + step[1:]) > reach[:-1]
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(end, at)


def segments(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts cut into segments that overlap by LENGTH - 1 bytes: text, start and end."""
    rows = []
    for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
        for s in range(a, max(b - LENGTH + 1, a), SEGMENT):
            rows.append((k, s, min(b, s + SEGMENT + LENGTH - 1)))
    r = np.array(rows, np.int64).reshape(-1, 3)
    return r[:, 0], r[:, 1], r[:, 2]


def window_hashes(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent mixed hashes of all bytes of each window."""
    t = token_matrix(data, place, np.full(len(place), LENGTH), -(-LENGTH // 8))
    a, b = np.full(len(place), 1, np.uint64), np.full(len(place), 2, np.uint64)
    with np.errstate(over="ignore"):
        for d in range(t.shape[1]):
            a, b = mix(a * PRIME + t[:, d]), mix((b ^ t[:, d]) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(d))
    return a, b


def _split(batch: pa.RecordBatch, plan: tuple[np.ndarray, np.ndarray, int, int]) -> Iterator[tuple[int, int, bytes]]:
    """One block of documents -> (bucket, kind, payload). Kinds: RUNS, WINDOWS at overloaded anchors (buckets from `ranges` * `parts` on), SPANS found already."""
    splitters, heavy, ranges, parts = plan
    total = ranges * parts
    data, off = byte_buffer(batch.column("text"))
    ids, rid = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False), np.int64) for c in ("ord", "rid"))
    text, start, end = segments(off)
    if not len(text):
        return
    bounds = np.concatenate(([0], np.cumsum(end - start)))
    own = np.concatenate([data[a:b] for a, b in zip(start, end, strict=True)])
    first, count, anchor = runs(own, bounds)
    seg = np.searchsorted(bounds, first, side="right") - 1
    who = text[seg]
    pos = first - bounds[seg] + start[seg] - off[who]
    # windows that repeat within the block are settled here and not sent
    hit, place = repeated(own, first, count, anchor, ids[who], pos)
    if len(hit):
        at = pos[hit] + place - first[hit]
        d, s, e = union(who[hit], at, at + LENGTH)
        for b in np.flatnonzero(np.bincount(d % total)):
            m = d % total == b
            yield int(b), SPANS, pack_arrays(ids[d[m]], rid[d[m]], s[m], e[m])
        touched = np.zeros(len(first), bool)
        touched[hit] = True
        n = np.where(touched, count, 0)
        base = np.cumsum(n) - n
        run = np.repeat(np.arange(len(first)), n)
        win = np.arange(n.sum()) - base[run] + first[run]
        left = np.ones(len(run), bool)
        left[base[hit] + place - first[hit]] = False
        run, win = run[left], win[left]
        new = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (win[1:] != win[:-1] + 1)))[: len(run)])
        run0, first0 = run[new], win[new]
        pos, who = np.concatenate((pos[~touched], pos[run0] + first0 - first[run0])), np.concatenate((who[~touched], who[run0]))
        first, count, anchor = np.concatenate((first[~touched], first0)), np.concatenate((count[~touched], np.diff(np.append(new, len(run))))), np.concatenate((anchor[~touched], anchor[run0]))
    lead = np.ascontiguousarray(own[np.minimum(anchor[:, None] + np.arange(16), len(own) - 1)]).view("S16").ravel()
    bucket = np.searchsorted(splitters, lead, side="right")
    if parts > 1:
        bucket = bucket * parts + (rolling(own)[anchor] % np.uint64(parts)).astype(np.int64)
    much = np.isin(lead, heavy) if len(heavy) else np.zeros(len(lead), bool)
    if much.any():
        n = count[much]
        run = np.repeat(np.flatnonzero(much), n)
        win = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[run]
        a, b = window_hashes(own, win)
        to = (a % np.uint64(total)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        cut = np.searchsorted(to[order], np.arange(total + 1))
        for k in np.flatnonzero(np.diff(cut)):
            m = order[cut[k] : cut[k + 1]]
            yield int(k) + total, WINDOWS, pack_arrays(a[m], b[m], ids[who[run[m]]], rid[who[run[m]]], pos[run[m]] + win[m] - first[run[m]])
    order = np.flatnonzero(~much)
    order = order[np.argsort(bucket[order], kind="stable")]
    cut = np.searchsorted(bucket[order], np.arange(total + 1))
    for k in np.flatnonzero(np.diff(cut)):
        m = order[cut[k] : cut[k + 1]]
        size = count[m] + LENGTH - 1
        place = np.repeat(first[m] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        docs, which = np.unique(who[m], return_inverse=True)
        yield int(k), RUNS, pack_arrays(own[place], count[m].astype(np.uint8), (anchor[m] - first[m]).astype(np.uint8), ids[docs], rid[docs], which.astype(np.uint32), pos[m].astype(np.int32) if len(pos) and pos.max() < 1 << 31 else pos[m])


def later(windows: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """Single windows (two hashes, ord, rid, place) of several payloads: which of them repeat an earlier one, and all, in order of documents."""
    rows = [np.concatenate(c) for c in zip(*windows, strict=True)]
    s = np.lexsort((rows[4], rows[2]))
    a, b, doc, rid, pos = (x[s] for x in rows)
    _, ka = np.unique(a, return_inverse=True)
    _, kb = np.unique(b, return_inverse=True)
    return first_only(ka.astype(np.int64) * (len(kb) + 1) + kb, doc, pos), [a, b, doc, rid, pos]


def _bucket(payloads: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs and spans that went to one bucket -> spans (ord, rid, start, end)."""
    none = np.zeros(0, np.int64)
    spans = [(none, none, none, none), *(unpack_arrays(raw) for kind, raw in payloads if kind == SPANS)]
    got = [unpack_arrays(raw) for kind, raw in payloads if kind == RUNS]
    if got:
        data, count, back, pos = (np.concatenate([g[i] for g in got]) for i in (0, 1, 2, 6))
        pos = pos.astype(np.int64)
        doc, rid = (np.concatenate([g[i][g[5]] for g in got]) for i in (3, 4))
        del got
        count, back = count.astype(np.int64), back.astype(np.int64)
        size = count + LENGTH - 1
        first = np.cumsum(size) - size
        hit, place = repeated(data, first, count, first + back, doc, pos)
        at = pos[hit] + place - first[hit]
        spans.append((doc[hit], rid[hit], at, at + LENGTH))
    return union_by_document(spans)


def union_by_document(spans: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of spans (ord, rid, start, end), document by document."""
    doc, rid, start, end = (np.concatenate([np.asarray(s[i], np.int64) for s in spans]) for i in range(4))
    if not len(doc):
        return doc, rid, start, end
    s = np.lexsort((rid, doc))
    new = np.concatenate(([True], (doc[s][1:] != doc[s][:-1]) | (rid[s][1:] != rid[s][:-1])))
    of = np.empty(len(s), np.int64)
    of[s] = np.cumsum(new) - 1
    lead = s[new]
    k, start, end = union(of, start, end)
    return doc[lead[k]], rid[lead[k]], start, end


def _sample(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in blocks(batches, "text", BLOCK):
        data, off = byte_buffer(b.column("text"))
        _, start, end = segments(off)
        for s, e in zip(start, end, strict=True):
            own = data[s:e]
            anchor = runs(own, np.array([0, e - s]))[2]
            anchor = anchor[:: max(1, len(anchor) // 32)]
            yield pa.RecordBatch.from_arrays([pa.array([own[a : a + 16].tobytes() for a in anchor], pa.binary())], names=["lead"])


def plan_of(d: DataFrame) -> tuple[tuple[np.ndarray, np.ndarray, int, int], int]:
    """Splitters, overloaded leading bytes (both bounded by MAX_RANGES), ranges, and parts of each range; groups of blocks for windows at overloaded anchors."""
    total, n = d.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()
    buckets = max(8, -(-total // BUCKET_BYTES))
    ranges, parts = min(buckets, MAX_RANGES), -(-buckets // MAX_RANGES)
    share = min(1.0, (3000 + 4 * ranges) / max(n, 1))
    lead = np.array([bytes(r[0]) for r in d.where(unit_hash("rid") < share).select("text").mapInArrow(lean(_sample), "lead binary").collect()], "S16")
    lead.sort()
    if not len(lead):
        return (np.zeros(0, "S16"), np.zeros(0, "S16"), ranges, parts), 1
    kinds, times = np.unique(lead, return_counts=True)
    heavy = kinds[times >= max(4, len(lead) / (8 * ranges))]
    rest = lead[~np.isin(lead, heavy)]
    splitters = rest[(np.arange(1, ranges) * len(rest)) // ranges] if len(rest) else rest
    return (splitters, heavy, ranges, parts), math.isqrt(total // BLOCK) + 1


def with_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The documents with their row key (`ord`, `rid`), and (ord, rid, s, e): starts and ends of the bytes to remove, where there are any."""
    d = docs.withColumn("text", F.col("text").cast("string"))
    d = d.withColumn("rid", F.xxhash64("doc_id", "text")).withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))))
    keyed = d.select("rid", "ord", "text")
    plan, salts = plan_of(keyed)
    shared = docs.sparkSession.sparkContext.broadcast(plan)
    total = plan[2] * plan[3]

    def split(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", BLOCK):
            salt = abs(b.column("rid")[0].as_py()) % salts
            for bucket, kind, raw in _split(b, shared.value):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([salt if kind == WINDOWS else 0], pa.int64()), pa.array([kind], pa.int32()), pa.array([raw], pa.binary())], names=["bucket", "salt", "kind", "payload"])

    bins = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: list[np.ndarray], where: np.ndarray, kind: int) -> Iterator[tuple[int, int, bytes]]:
        order = np.argsort(where, kind="stable")
        cut = np.searchsorted(where[order], np.arange(bins + 1))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            m = order[cut[k] : cut[k + 1]]
            yield k, kind, pack_arrays(*(x[m] for x in rows))

    def settle(table: pa.Table) -> pa.Table:
        """What a bucket found goes on in a row per bin of documents; the windows that are still first, in one per bin of windows."""
        raw = list(zip(table.column("kind").to_pylist(), table.column("payload").to_pylist(), strict=True))
        out: list[tuple[int, int, bytes]] = []
        if table.column("bucket")[0].as_py() >= total:
            gone, rows = later([unpack_arrays(x) for _, x in raw])
            if salts > 1:
                out += [(bins + k, kind, x) for k, kind, x in dealt([x[~gone] for x in rows], (rows[0][~gone] % np.uint64(bins)).astype(np.int64), WINDOWS)]
            doc, rid, pos = (x[gone] for x in rows[2:])
            spans = union_by_document([(doc, rid, pos, pos + LENGTH)])
        else:
            spans = _bucket(raw)
        out += dealt(list(spans), spans[1] % bins, SPANS)
        release()
        return pa.table([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.binary())], names=["bin", "kind", "payload"])

    def gather(table: pa.Table) -> pa.Table:
        parts = [unpack_arrays(x) for x in table.column("payload").to_pylist()]
        if table.column("kind")[0].as_py() == WINDOWS:
            gone, rows = later(parts)
            doc, rid, pos = (x[gone] for x in rows[2:])
            parts = [(doc, rid, pos, pos + LENGTH)]
        doc, rid, s, e = union_by_document(parts)
        at = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (rid[1:] != rid[:-1])))[: len(rid)])
        off = pa.array(np.append(at, len(rid)), pa.int32())
        return pa.table([pa.array(doc[at], pa.int64()), pa.array(rid[at], pa.int64()), pa.ListArray.from_arrays(off, pa.array(s)), pa.ListArray.from_arrays(off, pa.array(e))], names=["ord", "rid", "s", "e"])

    found = keyed.mapInArrow(lean(split), "bucket long, salt long, kind int, payload binary").groupBy("bucket", "salt").applyInArrow(settle, "bin long, kind int, payload binary")
    spans = found.groupBy("bin").applyInArrow(gather, "ord long, rid long, s array<long>, e array<long>")
    # a document has a row from the buckets' spans and some from windows settled last
    return d, spans.groupBy("ord", "rid").agg(F.flatten(F.collect_list("s")).alias("s"), F.flatten(F.collect_list("e")).alias("e"))


def remove_repeats(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per document: `columns` (doc_id), n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes)."""
    import zstandard

    columns = columns or ["doc_id"]
    d, spans = with_spans(docs.select("text", *dict.fromkeys(["doc_id", *columns])))
    small = d.select(*columns, "ord", "rid", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("raw"))

    def squeeze(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("raw")
            yield b.set_column(i, "raw", pa.array([zstandard.compress(x, 3) for x in b.column(i).to_pylist()], pa.binary()))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw, s, e in zip(b.column("raw").to_pylist(), b.column("s").to_pylist(), b.column("e").to_pylist(), strict=True):
                raw = zstandard.decompress(raw)
                if s:
                    _, s, e = union(np.zeros(len(s), np.int64), np.array(s), np.array(e))
                    keep = np.concatenate(([0], e)), np.append(s, len(raw))
                    left = b"".join(raw[i:j] for i, j in zip(*(x.tolist() for x in keep), strict=True))
                else:
                    s, left = [], raw
                rows.append((len(raw), len(raw) - len(left), len(s), hashlib.sha256(left).hexdigest(), left))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=[*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    kind = ", ".join(f"`{c}` {d.schema[c].dataType.simpleString()}" for c in columns)
    small = small.mapInArrow(lean(squeeze), small.schema)
    return small.join(spans, ["ord", "rid"], "left").mapInArrow(lean(cut), kind + ", n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

"""Language identification by cross-parsing entropy.

Per language a suffix automaton of labelled text recognises every substring of that text. A document is
cut greedily into phrases, each the longest match in the automaton from where the last one ended; with c
phrases over n letters and a training text of length m the cross-entropy estimate is c * log2(m) / n, and
the language that needs the fewest phrases so normalised wins. Every letter of the training text is a symbol
of its own, whatever the scripts. An automaton is a table (state, symbol) -> next state, dense for small
alphabets and hashed for large ones, so a whole block of documents is parsed in lockstep, in pieces of `PIECE`
symbols: each piece is parsed as if a phrase began with it, then again from where the piece before it really
ended, until a phrase begins at the same place in both. The phrases are those of the whole text.

All languages are learned. The training text is a bounded sample: up to `MAX_CHARS` characters per language
(less, but at least `LEAST_CHARS`, if that made more than `ALL_CHARS`) from about `MAX_DOCS` documents outside the
held-out fold with a language, chosen by hash of doc_id, with an equal share of each from a hashed place in its
text. Only the text is used to predict.

Nulls and empties: a null text, or one without a letter (combining marks alone are none), is `und` with score 0,
as is every text when nothing could be learned. Ties go to the language that sorts first. Repeated rows get
equal results. A very long text is held whole in one task. An empty table gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_large, blocks, held_out, lean, segment_sum, unit_hash

#: Characters and documents of training text per language, letters a piece.
MAX_CHARS, MAX_DOCS, PIECE = 50_000, 200, 256
#: Characters of all languages together, and the fewest per language.
ALL_CHARS, LEAST_CHARS = 1_000_000, 1000
#: The most cells of all dense tables of (state, symbol) together.
CELLS = 20_000_000


def fold_table() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> lower-case letter's or mark's code point, 32 for anything else; and which code points are letters."""
    out, letter = np.full(0x110000, 32, np.uint32), np.zeros(0x110000, bool)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000 or c > 0x323AF:
            continue
        ch = chr(c)
        kind = unicodedata.category(ch)[0]
        letter[c] = kind == "L"
        if kind in "LM":
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out, letter


def automaton(text: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a sequence of symbols."""
    nxt, link, length, last = [{}], [-1], [0], 0
    for ch in text:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and ch not in nxt[p]:
            nxt[p][ch] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][ch]
            if length[q] == length[p] + 1:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(ch) == q:
                    nxt[p][ch] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Edges:
    """The transitions of an automaton: a dense table; or else those of the root by symbol, all others in a hash table with open addressing."""

    def __init__(self, nxt: list[dict[int, int]], symbols: int, dense: bool):
        self.symbols = symbols
        self.root = np.zeros(symbols, np.int32)  # a symbol that the text lacks is a phrase of its own
        for ch, t in nxt[0].items():
            self.root[ch] = t
        self.dense = None
        if dense:  # next state * 2 + 1 if the symbol starts a new phrase
            table = np.tile(self.root * 2 + 1, (len(nxt), 1))
            for s, edges in enumerate(nxt):
                for ch, t in edges.items() if s else ():
                    table[s, ch] = t * 2
            self.dense = table.ravel()
            return
        key = np.array([s * symbols + ch for s, edges in enumerate(nxt) if s for ch in edges], np.int64)
        to = np.array([t for s, edges in enumerate(nxt) if s for t in edges.values()], np.int32)
        self.bits = max(4, int(2 * len(key)).bit_length())
        self.key, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        at = self.slot(key)
        while len(key):
            free = np.flatnonzero(self.key[at] < 0)
            _, lead = np.unique(at[free], return_index=True)
            put = free[lead]
            self.key[at[put]], self.to[at[put]] = key[put], to[put]
            left = np.ones(len(key), bool)
            left[put] = False
            key, to, at = key[left], to[left], (at[left] + 1) & ((1 << self.bits) - 1)

    def slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and which symbols start a new phrase: where there is no transition, and always from the root."""
        if self.dense is not None:
            v = self.dense[state * self.symbols + sym]
            return v >> 1, v & 1
        key = state.astype(np.int64) * self.symbols + sym
        at = self.slot(key)
        seen = self.key[at]
        new = seen != key
        open_ = np.flatnonzero(new & (seen >= 0))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            seen = self.key[at[open_]]
            new[open_] = seen != key[open_]
            open_ = open_[(seen != key[open_]) & (seen >= 0)]
        return np.where(new, self.root[sym], self.to[at]), new


class Languages:
    def __init__(self, texts: dict[str, str]):
        table, self.letter = fold_table()
        self.names = sorted(texts)
        coded = {k: squeeze(table[np.frombuffer(texts[k].encode("utf-32-le", "replace"), np.uint32)], None)[0] for k in self.names}
        every = np.concatenate([*coded.values(), np.zeros(0, np.uint32)])
        letters = np.unique(every[every != 32])
        small = np.full(0x110000, 2, np.int32)  # 1 no letter, 2 a letter that no training text has
        small[32], small[letters] = 1, np.arange(3, 3 + len(letters))
        self.symbol = small[table]
        dense = 2 * sum(map(len, coded.values())) * (3 + len(letters)) <= CELLS  # an automaton has at most twice as many states as its text letters
        self.tables = [Edges(automaton(small[coded[k]].tolist()), 3 + len(letters), dense) for k in self.names]
        self.bits = np.array([np.log2(max(len(coded[k]), 2)) for k in self.names])

    def phrases(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: phrases by language, symbols, and letters."""
        texts = as_large(text).to_pylist()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        off = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        letters = segment_sum(self.letter[points].astype(np.int64), off)
        sym, off = squeeze(self.symbol[points], off, gap=1)
        size = np.diff(off)
        pieces = -(-size // PIECE)
        doc = np.repeat(np.arange(len(size)), pieces)
        start = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = off[doc] + start * PIECE
        end = np.minimum(start + PIECE, off[doc + 1])
        order = np.argsort(start - end, kind="stable")  # long pieces first: a step touches only those that still run
        at, size_of = start[order], (end - start)[order]
        running = np.searchsorted(-size_of, -np.arange(PIECE), side="left")
        follows = np.concatenate((np.zeros(1, bool), doc[1:] == doc[:-1]))[: len(doc)]  # pieces that go on with the one before
        found = np.zeros((len(size), len(self.names)))
        for k, t in enumerate(self.tables):
            state, begins = np.zeros(len(doc), np.int32), np.zeros((len(doc), PIECE), bool)
            for step in range(PIECE):
                n = running[step]
                if not n:
                    break
                state[:n], begins[:n, step] = t.step(state[:n], sym[at[:n] + step])
            last = np.empty_like(state)
            last[order] = state
            natural = np.empty_like(begins)
            natural[order] = begins
            begins, count = natural, natural.sum(1)
            todo = np.flatnonzero(follows)
            while len(todo):
                todo = self.go_on(t, sym, start, end, begins, last, count, todo)
                todo = todo[(todo + 1 < len(doc))] + 1
                todo = todo[follows[todo]]
            found[:, k] = np.bincount(doc, count, minlength=len(size))
        return found, size, letters

    @staticmethod
    def go_on(t: Edges, sym: np.ndarray, start: np.ndarray, end: np.ndarray, begins: np.ndarray, last: np.ndarray, count: np.ndarray, todo: np.ndarray) -> np.ndarray:
        """Parse pieces from where the pieces before them ended, until both parses begin a phrase at one place. Corrects `count` and `last`; which pieces now end otherwise."""
        state, seen, piece, changed = last[todo - 1], np.zeros(len(todo), np.int64), todo, []
        for step in range(PIECE):
            over = start[piece] + step >= end[piece]
            if over.any():
                done = piece[over]
                changed.append(done[last[done] != state[over]])
                last[done], count[done] = state[over], seen[over]
                piece, state, seen = piece[~over], state[~over], seen[~over]
            if not len(piece):
                break
            state, new = t.step(state, sym[start[piece] + step])
            seen = seen + new
            met = (new > 0) & begins[piece, step]
            if met.any():
                count[piece[met]] = seen[met] + begins[piece[met], step + 1 :].sum(1)
                piece, state, seen = piece[~met], state[~met], seen[~met]
        if len(piece):
            changed.append(piece[last[piece] != state])
            last[piece], count[piece] = state, seen
        return np.sort(np.concatenate(changed)) if changed else np.zeros(0, np.int64)

    def predict(self, text: pa.Array) -> tuple[list[str], np.ndarray]:
        if not self.names:
            return ["und"] * len(text), np.zeros(len(text))
        found, size, letters = self.phrases(text)
        cost = found * self.bits / np.maximum(size, 1)[:, None]
        best = cost.argmin(1)
        ordered = np.sort(cost, 1)
        first, second = ordered[:, 0], ordered[:, min(1, ordered.shape[1] - 1)]
        score = np.where(letters > 0, second / np.maximum(first + second, 1e-12) if len(self.names) > 1 else 1.0, 0.0)
        return [self.names[b] if ok else "und" for b, ok in zip(best, letters > 0, strict=True)], np.clip(score, 0, 1)


def squeeze(sym: np.ndarray, off: np.ndarray | None, gap: int = 32) -> tuple[np.ndarray, np.ndarray | None]:
    """Runs of what is no letter become one symbol."""
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] != gap) | (sym[:-1] != gap)
    if off is None:
        return sym[keep], None
    keep[off[:-1][off[:-1] < len(sym)]] = True
    return sym[keep], np.concatenate(([0], np.cumsum(keep)))[off]


def fit(docs: DataFrame) -> Languages:
    known = docs.where("lang is not null and text is not null").where(~held_out("doc_id")).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return Languages({})
    most = max(LEAST_CHARS, min(MAX_CHARS, ALL_CHARS // len(counts)))
    # the shares are literals of the scan's filter, so no text is shuffled; about MAX_DOCS pieces of text per language reach the driver
    by_lang = lambda f: F.try_element_at(F.create_map(*(F.lit(x) for r in counts for x in (r["lang"], f(r["count"])))), F.col("lang"))
    chosen = known.where(unit_hash("doc_id") < F.coalesce(by_lang(lambda n: min(1.0, MAX_DOCS / n)), F.lit(0.0)))
    take = by_lang(lambda n: -(-2 * most // min(n, MAX_DOCS)))
    place = F.floor(unit_hash("doc_id", F.lit(1)) * F.greatest(F.length("text") - take + 1, F.lit(1))).cast("int") + 1
    rows = chosen.select(unit_hash("doc_id").alias("h"), "doc_id", "lang", F.substr("text", place, take).alias("text")).toArrow().sort_by([("h", "ascending"), ("doc_id", "ascending"), ("text", "ascending")]).to_pylist()
    texts: dict[str, str] = {}
    for r in rows:
        texts[r["lang"]] = (texts.get(r["lang"], "") + "\n" + r["text"])[:most]
    return Languages(texts)


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every document."""
    model = fit(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 2 << 20):
            names, score = model.predict(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id bigint, lang_pred string, score double")
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")

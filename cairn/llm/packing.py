"""Packing by power-of-two decomposition.

A document's token ids are cut into pieces whose lengths are powers of two: as many pieces of `MAX_LENGTH`
as fit, then the binary digits of what is left, largest first. Every piece is a sequence of its own, so
no sequence crosses documents, none needs padding, and equal lengths can be batched together: the bucket
(length) is a column and sequence ids are numbered so that a scan's sequences of one bucket are adjacent.

Tokens are those of a public tokenizer over the whole text, with the end id appended; the tokenizer's
file is a parameter. Where its words are those of `RULES`, which never cross white space, ids are looked up
by white-space-separated piece, and only pieces not met before are tokenised; any other tokenizer gets
whole texts.

Nulls: a null text is empty and yields one piece, the end id; a null doc_id stays null. Repeated rows are
packed once each. Further columns are ignored.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, byte_buffer, lean

MAX_LENGTH, END_ID = 4096, 2
#: Pieces of text, and words within them, whose ids a task remembers.
REMEMBERED = 250_000
#: The normaliser and the word pattern under which pieces between white space can be tokenised by themselves.
RULES = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}], r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts of ASCII and plain Latin letters need no Unicode tables to be cut into words as the tokenizer does; others go through it whole.
PLAIN = re.compile("[\x21-\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")
WORDS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u017f]+|[0-9]|[^a-z\u00df-\u00f6\u00f8-\u017f0-9]+")
SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket int"


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, the same as the tokenizer gives for the whole text."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_piece = self.has_rules(json.loads(self.tokenizer.to_str()))
        self.model = self.tokenizer.model
        self.letters = str.maketrans({chr(b): c for b, c in byte_letters().items()})
        self.known: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    @staticmethod
    def has_rules(spec: dict) -> bool:
        steps = (spec["normalizer"] or {}).get("normalizers"), (spec["pre_tokenizer"] or {}).get("pretokenizers")
        return steps[0] == RULES[0] and [x["type"] for x in steps[1] or []] == ["Split", "ByteLevel"] and steps[1][0]["pattern"] == {"Regex": RULES[1]}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, w: str) -> bytes:
        got = self.words.get(w)
        if got is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            spelled = w.encode().decode("latin-1").translate(self.letters)
            got = self.words[w] = struct.pack(f"<{len(ids)}I", *ids) if (ids := [t.id for t in self.model.tokenize(spelled)]) else b""
        return got

    def piece(self, raw: bytes) -> bytes:
        """Ids of a piece without ASCII white space."""
        text = raw.decode("utf-8", "replace")
        if PLAIN.fullmatch(text) and "<|" not in text:
            return b"".join(map(self.word, WORDS.findall(text.lower())))
        return self.whole(text)

    def encode_many(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_piece:
            return [self.whole(t.decode("utf-8", "replace")) for t in texts]
        known, out = self.known, []
        for t in texts:
            pieces = t.split()
            new = set(pieces).difference(known)
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(pieces)
            for raw in new:
                known[raw] = self.piece(raw)
            out.append(b"".join(map(known.__getitem__, pieces)))
        return out


def lengths(total: int) -> list[int]:
    """The pieces of a document of `total` ids, in order."""
    rest = total % MAX_LENGTH
    return [MAX_LENGTH] * (total // MAX_LENGTH) + [1 << k for k in range(MAX_LENGTH.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece; `with_ids` adds the ids themselves."""
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        encoder = Encoder(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        sequence = TaskContext.get().partitionId() << 40
        for b in blocks(batches, "text"):
            data, off = byte_buffer(b.column("text"))
            raw = data.tobytes()
            ids = encoder.encode_many([raw[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)])
            rows: list[tuple] = []
            kept: list[bytes] = []
            for doc, x in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                x += end
                start, total = 0, len(x) // 4
                for n in lengths(total):
                    part = x[4 * start : 4 * (start + n)]
                    rows.append((doc, start, n, zlib.crc32(part), total))
                    if with_ids:
                        kept.append(part)
                    start += n
            cols = list(zip(*rows, strict=True))
            size = np.array(cols[2], np.int64)
            number = np.empty(len(rows), np.int64)
            number[np.argsort(size, kind="stable")] = np.arange(len(rows)) + sequence
            sequence += len(rows)
            arrays = [*(pa.array(c, pa.int64()) for c in cols), pa.array(number), pa.array(np.zeros(len(rows), np.int64)), pa.array(size.astype(np.int32))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "bucket"]
            if with_ids:
                arrays.append(pa.array([np.frombuffer(k, "<u4").astype(np.int32) for k in kept], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(lean(run), SCHEMA + ", ids array<int>" * with_ids)

"""Byte-level BPE: encode texts to ids and decode ids to bytes.

The vocabulary is a rank file of a public tokenizer (its path is a parameter):
lines of base64 bytes and a rank, which is the id. A text is split by the
tokenizer's pattern; each match is merged by itself as in :mod:`.bpe`.

Semantics: a null text is the empty text (no ids). Texts of any length are
encoded whole. Repeated rows give repeated results; other columns are not
read. Equal chunks of a task's texts are encoded once (bounded cache).
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PairTable, WordCache, merge_rows
from .common import ragged, slices

#: A space beside other white space; any white space but space and line feed.
_RUNS = ("  ", " \n", "\n ")
_RARE = re.compile(r"[^\S \n]")


class ByteBpe:
    """Encoder and decoder over one rank file and split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self._pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        self._symbol = np.zeros(256, np.int32)
        for byte in range(256):
            self._symbol[byte] = ranks[bytes([byte])]
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self._pairs = PairTable(left, right, rank, rank)
        lengths = np.zeros(size, np.int64)
        for token, r in ranks.items():
            lengths[r] = len(token)
        tokens = sorted((r, token) for token, r in ranks.items())
        self._bytes = np.frombuffer(b"".join(t for _, t in tokens), np.uint8)
        self._lengths = lengths
        self._starts = np.cumsum(lengths) - lengths
        self._cache = WordCache(self._encode_chunks)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        return cls(ranks, pattern)

    def _encode_chunks(self, chunks):
        find = self._pattern.findall
        pieces = [
            (c,) if c.isalpha() or (c[0] == " " and c[1:].isalpha()) else find(c) for c in chunks
        ]
        each = list(chain.from_iterable(pieces))
        unique = list(set(each))
        number = dict(zip(unique, range(len(unique)), strict=True))
        raw = [p.encode() for p in unique]
        flat = self._symbol[np.frombuffer(b"".join(raw), np.uint8)]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        ids, starts, counts = merge_rows(flat, lengths, self._pairs)
        at = np.fromiter(map(number.__getitem__, each), np.int64, len(each))
        starts, counts = starts[at], counts[at]
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum([0, *map(len, pieces)])
        return ids[ragged(starts, counts)], sums[ends[:-1]], sums[ends[1:]] - sums[ends[:-1]]

    def _chunks(self, text: str) -> list[str]:
        """Pieces of the text that no match of the pattern crosses.

        A single space between two other characters always begins a match, so
        a text without runs of white space may be cut before each space.
        Other texts are split by the pattern as a whole.
        """
        if not text:
            return []
        if text[0] != " " != text[-1] and not any(r in text for r in _RUNS) and not _RARE.search(text):
            first, *rest = text.split(" ")
            return [first, *[" " + w for w in rest]]
        return self._pattern.findall(text)

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, ids per text)."""
        return self._cache.ids([self._chunks(t) for t in texts])

    def decode(self, ids: np.ndarray) -> bytes:
        return self._bytes[ragged(self._starts[ids], self._lengths[ids])].tobytes()


@lru_cache(maxsize=2)
def _codec(path: str, pattern: str) -> ByteBpe:
    return ByteBpe.load(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id"):
    """(doc_id, ids array, bytes decoded from them) per row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1).to_pylist()):
                flat, counts = codec.encode_batch(part)
                ends = np.cumsum(counts)
                ids = pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, pa.int32())
                )
                decoded = [
                    codec.decode(flat[e - c : e])
                    for e, c in zip(ends.tolist(), counts.tolist(), strict=True)
                ]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(part)), ids, pa.array(decoded, pa.binary())],
                    ["doc_id", "ids", "decoded"],
                )
                at += len(part)

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(
        run, "doc_id long, ids array<int>, decoded binary"
    )


def encode_digests(
    docs: DataFrame, path: str, pattern: str, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Encode and decode every row; return counts and digests instead of the ids.

    The same codec as :func:`encode`; ids and bytes stay inside the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path, pattern)
        for batch in batches:
            n_tokens, ids_sha, decoded_sha = [], [], []
            for part in slices(batch.column(1).to_pylist()):
                flat, counts = codec.encode_batch(part)
                raw = flat.astype("<u4")
                ends = np.cumsum(counts).tolist()
                for end, count in zip(ends, counts.tolist(), strict=True):
                    ids = raw[end - count : end]
                    n_tokens.append(count)
                    ids_sha.append(hashlib.sha256(ids).hexdigest())
                    decoded_sha.append(hashlib.sha256(codec.decode(flat[end - count : end])).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()),
                 pa.array(decoded_sha, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(
        run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

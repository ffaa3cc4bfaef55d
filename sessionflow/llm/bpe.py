"""Byte-pair merging of many short rows at once in numpy.

Rows of symbol ids are bucketed by length into padded matrices. In each round
every row merges its leftmost pair of least rank: pairs are looked up in an
open-addressing hash table, only the two pairs beside a merge are looked up
again, and finished rows and unused columns are compacted away. Rows beyond
``LONG_ROW`` symbols (one unbroken run of that many bytes) follow the same
order, least rank then leftmost, with a heap, so that a run of a million
characters does not cost its square.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence
from itertools import chain

import numpy as np

from .common import ragged

NO_RANK = np.int32(2**31 - 1)
LONG_ROW = 512
MATRIX_CELLS = 262_144
_EMPTY = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)  # 2^64 / golden ratio, odd


class PairTable:
    """Hash table from a pair of symbol ids to (rank, merged id)."""

    def __init__(self, left, right, rank, merged):
        keys = self._key(np.asarray(left), np.asarray(right))
        bits = max(4, int(len(keys) * 4).bit_length())
        self._shift = np.uint64(64 - bits)
        self._mask = np.int64(2**bits - 1)
        self._keys = np.full(2**bits, _EMPTY, np.uint64)
        self._ranks = np.full(2**bits, NO_RANK, np.int32)
        self._merged = np.zeros(2**bits, np.int32)
        at = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = self._keys[at[todo]] == _EMPTY
            self._keys[at[todo[free]]] = keys[todo[free]]
            todo = todo[self._keys[at[todo]] != keys[todo]]  # slot taken: go on to the next
            at[todo] = (at[todo] + 1) & self._mask
        self._ranks[at] = rank
        self._merged[at] = merged

    @staticmethod
    def _key(left, right):
        return left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)

    def _slot(self, keys):
        return (keys * _MIX >> self._shift).astype(np.int64)

    def _find(self, left, right):
        keys = self._key(left, right).ravel()
        at = self._slot(keys)
        seen = self._keys[at]
        todo = np.nonzero((seen != keys) & (seen != _EMPTY))[0]
        while len(todo):
            at[todo] = (at[todo] + 1) & self._mask
            seen = self._keys[at[todo]]
            todo = todo[(seen != keys[todo]) & (seen != _EMPTY)]
        return at.reshape(np.shape(left))  # a free slot has no rank

    def ranks(self, left, right):
        return self._ranks[self._find(left, right)]

    def merges(self, left, right):
        return self._merged[self._find(left, right)]

    def one(self, left: int, right: int) -> tuple[int, int]:
        at = self._find(np.array([left]), np.array([right]))[0]
        return int(self._ranks[at]), int(self._merged[at])


def _merge_long(row: np.ndarray, pairs: PairTable) -> np.ndarray:
    ids = row.tolist()
    n = len(ids)
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    alive = [True] * n
    ranks = pairs.ranks(row[:-1], row[1:])
    heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(ranks) if r != NO_RANK]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i] if alive[i] else n
        if j >= n or ids[i] != a or ids[j] != b:
            continue
        ids[i], alive[j] = pairs.one(a, b)[1], False
        right[i] = right[j]
        if right[i] < n:
            left[right[i]] = i
        for x, y in ((left[i], i), (i, right[i])):
            if x >= 0 and y < n:
                rank = pairs.one(ids[x], ids[y])[0]
                if rank != NO_RANK:
                    heapq.heappush(heap, (rank, x, ids[x], ids[y]))
    return np.array([v for v, ok in zip(ids, alive, strict=True) if ok], np.int32)


def _merge_matrix(x, lens, where, pairs, out, offsets, counts) -> None:
    """Merge the padded rows ``x`` and write them at ``offsets[where]``."""
    cols = np.arange(x.shape[1])
    ranks = np.where(
        cols[None, 1:] < lens[:, None], pairs.ranks(x[:, :-1], x[:, 1:]), NO_RANK
    )
    while True:
        width = x.shape[1]
        best = ranks.argmin(1) if width > 1 else np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        done = ranks[rows, best] == NO_RANK if width > 1 else np.ones(len(x), bool)
        if done.any():
            ended = np.nonzero(done)[0]
            counts[where[ended]] = lens[ended]
            live = cols[None, :width] < lens[ended, None]
            out[(offsets[where[ended], None] + cols[None, :width])[live]] = x[ended][live]
            keep = np.nonzero(~done)[0]
            if not len(keep):
                return
            width = int(lens[keep].max())
            x, ranks = x[keep][:, :width], ranks[keep][:, : width - 1]
            lens, where, best = lens[keep], where[keep], best[keep]
            rows = np.arange(len(x))
        merged = pairs.merges(x[rows, best], x[rows, best + 1])
        after = cols[None, : width - 1] > best[:, None]
        x[:, :-1] = np.where(after, x[:, 1:], x[:, :-1])
        if width > 2:
            ranks[:, :-1] = np.where(after[:, : width - 2], ranks[:, 1:], ranks[:, :-1])
        ranks[:, -1] = NO_RANK
        x[rows, best] = merged
        lens = lens - 1
        back = np.nonzero(best > 0)[0]
        at = best[back]
        ranks[back, at - 1] = pairs.ranks(x[back, at - 1], x[back, at])
        ranks[rows, best] = NO_RANK
        ahead = np.nonzero(best + 1 < lens)[0]
        at = best[ahead]
        ranks[ahead, at] = pairs.ranks(x[ahead, at], x[ahead, at + 1])


def merge_rows(flat: np.ndarray, lengths: np.ndarray, pairs: PairTable):
    """Merge rows of symbols laid one after another.

    Returns (ids, starts, counts): row i became ``ids[starts[i]:starts[i] + counts[i]]``.
    """
    lengths = np.asarray(lengths, np.int64)
    offsets = np.cumsum(lengths) - lengths
    out = np.empty(len(flat), np.int32)
    counts = np.zeros(len(lengths), np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[np.searchsorted(lengths[order], 1) :]
    at = 0
    while at < len(order):
        longest = int(lengths[order[at]])
        if longest > LONG_ROW:
            i = order[at]
            row = _merge_long(flat[offsets[i] : offsets[i] + longest], pairs)
            counts[i] = len(row)
            out[offsets[i] : offsets[i] + len(row)] = row
            at += 1
            continue
        width = longest if longest <= 16 else min(LONG_ROW, 1 << (longest - 1).bit_length())
        end = int(np.searchsorted(lengths[order], width, side="right"))
        end = min(end, at + max(1, MATRIX_CELLS // width))
        where = order[at:end]
        lens = lengths[where]
        cols = np.arange(width)
        live = cols[None, :] < lens[:, None]
        x = np.zeros((len(where), width), np.int32)
        x[live] = flat[(offsets[where, None] + cols[None, :])[live]]
        _merge_matrix(x, lens, where, pairs, out, offsets, counts)
        at = end
    return out, offsets, counts


class WordCache:
    """Ids of chunks seen before, as ranges of one growing array.

    ``encode(chunks) -> (ids, starts, counts)`` gives the ids of new chunks.
    The cache starts over beyond ``limit`` chunks, so its memory is bounded.
    """

    def __init__(self, encode, limit: int = 400_000):
        self._encode, self._limit = encode, limit
        self._reset()

    def _reset(self):
        self._index: dict[str, int] = {}
        self._starts = np.empty(1024, np.int64)
        self._counts = np.empty(1024, np.int64)
        self._flat = np.empty(4096, np.int32)
        self._used = 0

    @staticmethod
    def _grown(a: np.ndarray, size: int) -> np.ndarray:
        if size <= len(a):
            return a
        b = np.empty(max(size, 2 * len(a)), a.dtype)
        b[: len(a)] = a
        return b

    def _add(self, chunks: Sequence[str]) -> None:
        ids, starts, counts = self._encode(chunks)
        packed = ids[ragged(starts, counts)]
        old = len(self._index)
        new = old + len(chunks)
        self._starts = self._grown(self._starts, new)
        self._counts = self._grown(self._counts, new)
        self._flat = self._grown(self._flat, self._used + len(packed))
        self._starts[old:new] = self._used + np.cumsum(counts) - counts
        self._counts[old:new] = counts
        self._flat[self._used : self._used + len(packed)] = packed
        self._used += len(packed)
        self._index.update(zip(chunks, range(old, new), strict=True))

    def ids(self, docs: Sequence[Sequence[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of documents given as lists of chunks: (flat ids, ids per document)."""
        if len(self._index) > self._limit:
            self._reset()
        new = set().union(*docs).difference(self._index)
        if new:
            self._add(list(new))
        get = self._index.__getitem__
        at = np.fromiter(map(get, chain.from_iterable(docs)), np.int64, sum(map(len, docs)))
        counts = self._counts[at]
        flat = self._flat[ragged(self._starts[at], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum([0, *map(len, docs)])
        return flat, sums[ends[1:]] - sums[ends[:-1]]

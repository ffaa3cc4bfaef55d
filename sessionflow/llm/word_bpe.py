"""Ids of a ``tokenizers`` BPE file with word ends, for whole documents.

White space separates words before the merges, so each word is encoded by
itself, once per task while it stays in a bounded cache, which finds words by
64-bit hashes and is dropped with its task. Words of ASCII and
Latin letters go through the file's split pattern and merge list with the
matrices of :mod:`.bpe`; any other word, and any word that might hold a
special token, goes through the ``tokenizers`` library itself. Other kinds of
files are encoded by the library throughout.
"""

from __future__ import annotations

import json
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from tokenizers import Tokenizer

from .bpe import PairTable, merge_rows
from .common import ragged, slices, word_hashes

#: Characters whose words are looked up at once.
LOOKUP_CHARS = 1_000_000
#: Words remembered, ids kept for them, and letters of the longest of them.
CACHE_WORDS, CACHE_IDS, CACHE_LETTERS = 400_000, 8_000_000, 64

# Printable ASCII and Latin letters that no normal form changes, by code point, and what
# parts words; all code points beyond count as the last.
_COMMON = np.zeros(0x181, bool)
_COMMON[0x21:0x7F] = _COMMON[0xA1:0xAD] = _COMMON[0xAE:0x180] = True
_BLANK = np.zeros(0x181, bool)
_BLANK[[9, 10, 13, 32]] = True


def _points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), np.uint32(0x180))


def _ends(words: list[str], apart: int) -> np.ndarray:
    """Where each word ends in all of them joined by ``apart`` characters."""
    return np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + apart) - apart


class HashedWords:
    """Ids of words seen before, found by the words' hashes.

    ``encode(words) -> (ids, starts, counts)`` gives the ids of new words. Beyond
    ``CACHE_WORDS`` words or ``CACHE_IDS`` ids it starts over, so its memory is
    bounded. Words of more than ``CACHE_LETTERS`` letters are encoded anew.
    """

    def __init__(self, encode):
        self._encode = encode
        self._reset()

    def _reset(self):
        self._keys, self._number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self._starts, self._counts = np.empty(0, np.int64), np.empty(0, np.int32)
        self._flat = np.empty(0, np.int32)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, ids per text)."""
        if len(self._counts) > CACHE_WORDS or len(self._flat) > CACHE_IDS:
            self._reset()
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        blank = np.concatenate([[True], _BLANK[np.minimum(points, np.uint32(0x180))], [True]])
        start = np.nonzero(blank[:-1] & ~blank[1:])[0]
        length = np.nonzero(~blank[:-1] & blank[1:])[0] - start
        short = length <= CACHE_LETTERS
        begun = start[short]
        found, first, of = np.unique(
            word_hashes(points, begun, length[short]), return_index=True, return_inverse=True
        )
        place = np.searchsorted(self._keys, found)
        old = place < len(self._keys)
        old[old] = self._keys[place[old]] == found[old]
        new = first[~old]
        words = [joined[i : i + n] for i, n in zip(begun[new].tolist(), length[short][new].tolist(), strict=True)]
        long = [joined[i : i + n] for i, n in zip(start[~short].tolist(), length[~short].tolist(), strict=True)]
        known = len(self._counts)
        if words or long:
            ids, starts, counts = self._encode(words + long)
            self._starts = np.concatenate([self._starts, len(self._flat) + np.cumsum(counts) - counts])
            self._counts = np.concatenate([self._counts, counts.astype(np.int32)])
            self._flat = np.concatenate([self._flat, ids[ragged(starts, counts)]])
        number = np.empty(len(found), np.int64)
        number[old] = self._number[place[old]]
        number[~old] = np.arange(known, known + len(words))
        self._keys = np.insert(self._keys, place[~old], found[~old])
        self._number = np.insert(self._number, place[~old], number[~old].astype(np.int32))
        at = np.empty(len(start), np.int64)
        at[short] = number[of]
        at[~short] = np.arange(known + len(words), known + len(words) + len(long))
        counts = self._counts[at].astype(np.int64)
        flat = self._flat[ragged(self._starts[at], counts)]
        sums = np.concatenate([[0], np.cumsum(counts)])
        bounds = np.searchsorted(start, np.concatenate([[0], _ends(texts, 1)]))
        return flat, sums[bounds[1:]] - sums[bounds[:-1]]


def _byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, extra = {b: chr(b) for b in shown}, 256
    for byte in range(256):
        if byte not in letters:
            letters[byte], extra = chr(extra), extra + 1
    return [letters[b] for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        self._library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [s["type"] for s in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self._known = (
            steps == ["NFC", "Replace", "Lowercase"]
            and [s.get("type") for s in splits] == ["Split", "ByteLevel"]
            and splits[0].get("invert") and splits[0].get("behavior") == "Removed"
            and model["type"] == "BPE" and model["end_of_word_suffix"]
            and not model["ignore_merges"] and not model["dropout"]
        )
        if not self._known:
            return
        self._split = regex.compile(splits[0]["pattern"]["Regex"])
        self._specials = [t["content"] for t in spec["added_tokens"]]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        letters = _byte_letters()
        self._inner = np.array([vocab[c] for c in letters], np.int32)
        self._last = np.array([vocab[c + end] for c in letters], np.int32)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self._pairs = PairTable(
            [vocab[a] for a, _ in merges],
            [vocab[b] for _, b in merges],
            np.arange(len(merges)),
            [vocab[a + b] for a, b in merges],
        )

    def _encode_words(self, words):
        joined = "\n".join(words)
        points, ends = _points(joined), _ends(words, 1)
        odd = np.nonzero(~_COMMON[points] & (points != 10))[0]
        common = np.ones(len(words), bool)
        common[np.searchsorted(ends, odd, "right")] = False
        if any(s in joined for s in self._specials):
            common &= [not any(s in w for s in self._specials) for w in words]
        find = self._split.findall
        pieces = [
            ((w,) if w.isalpha() else find(w)) if ok else ()
            for w, ok in zip(joined.lower().split("\n"), common.tolist(), strict=True)
        ]
        each = list(chain.from_iterable(pieces))
        unique = list(set(each))
        number = dict(zip(unique, range(len(unique)), strict=True))
        letters = "".join(unique)
        text = np.frombuffer(letters.encode(), np.uint8)
        stops = np.cumsum(np.concatenate([[0], 1 + (_points(letters) > 0x7F)]))
        lengths = np.diff(stops[np.concatenate([[0], _ends(unique, 0)])])
        flat = self._inner[text]
        ends = np.cumsum(lengths) - 1
        flat[ends] = self._last[text[ends]]
        ids, starts, counts = merge_rows(flat, lengths, self._pairs)
        at = np.fromiter(map(number.__getitem__, each), np.int64, len(each))
        starts, counts = starts[at], counts[at]
        sums = np.concatenate([[0], np.cumsum(counts)])
        stops = np.cumsum([0, *map(len, pieces)])
        flat = ids[ragged(starts, counts)]
        starts, counts = sums[stops[:-1]], sums[stops[1:]] - sums[stops[:-1]]
        rare = np.nonzero(~common)[0].tolist()
        if rare:
            got = self._library.encode_batch([words[i] for i in rare], add_special_tokens=False)
            more = [e.ids for e in got]
            sizes = np.array([len(m) for m in more], np.int64)
            starts[rare] = len(flat) + np.cumsum(sizes) - sizes
            counts[rare] = sizes
            flat = np.concatenate([flat, np.array(list(chain.from_iterable(more)), np.int32)])
        return flat, starts, counts

    def cache(self) -> HashedWords:
        """What a task remembers of its words, for ``encode_batch``."""
        return HashedWords(self._encode_words)

    def encode_batch(
        self, texts: list[str], words: HashedWords | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after another, ids per text)."""
        words = words or self.cache()
        if not self._known:
            got = [e.ids for e in self._library.encode_batch(texts, add_special_tokens=False)]
            counts = np.array([len(g) for g in got], np.int64)
            return np.array(list(chain.from_iterable(got)), np.int32), counts
        got = [words.ids(part) for part in slices(texts, LOOKUP_CHARS)]
        flat, counts = zip(*got, strict=True) if got else ((np.empty(0, np.int32),), (np.empty(0, np.int64),))
        return np.concatenate(flat), np.concatenate(counts)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)

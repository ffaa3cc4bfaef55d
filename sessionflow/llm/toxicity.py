"""Toxicity: restore disguised words, then score the restored text.

Words that are not plain letters (leetspeak, spaced or separated letters,
repeated letters) become character lattices: each sign may stand for itself,
for a letter it resembles, for a word break or for nothing, at a cost. A
Viterbi search under a character trigram model, linear in the length, finds
the likeliest spelling. A spelling that the vocabulary (the common words of the
corpus) lacks may be several words glued together: of all its splits the
cheapest is taken, where a word of the vocabulary costs its rareness, any other
stretch its letters under the character model, and each space left out a
price. This holds for tokens of any length. The trigram counts and the
vocabulary come from every text of the corpus, added up by grouped aggregations.

The restored words and their beginnings are features of a logistic model.
Which features it holds is chosen from document counts per label over all
labelled rows that are not held out; it is fitted on all of them by Spark's
logistic regression. ``scored`` restores every text once, for the fit and for
the score.

Semantics: a null text is empty and scored like any other. The label of a row
is looked up by its id. Without labels of both kinds every score is the share
of label 1 (0.5 without labels). Repeated rows score alike.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import maybe_among, slices, staged, word_hashes
from .quality import labelled_ids

#: Features of the logistic model, and its penalty over the sum of losses.
FEATURES = 4_000
PENALTY, STEPS = 0.1, 50
#: Least documents that hold a feature or a word of the vocabulary: so many, and
#: this share of them.
LEAST_DOCUMENTS, LEAST_SHARE = 4, 1 / 5_000
PREFIXES = (4, 5, 6)
#: Distinct tokens whose words one task remembers, by their hashes.
CACHE_WORDS = 400_000
#: Words whose splits it remembers beside them.
CACHE_PARTED = 60_000
#: Distinct words or features that one task counts before it hands them on.
TALLY_WORDS = 400_000
#: Characters whose words are found at once.
READ_CHARS = 1_000_000
#: Characters whose trigrams or features are counted at once.
COUNT_CHARS = 400_000

# Signs that stand for letters.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e",
}
LEET_COST, SKIP_COST, KEEP_SIGN_COST, FOLD_COST, KEEP_RUN_COST = 0.5, 0.5, 6.0, 0.7, 3.0
#: A sign that resembles a letter is rarely there for nothing.
SKIP_LEET_COST = 12.0
#: At a token's end a sign may be punctuation.
END_COST = {"!": 0.0, "|": 3.0}
END_LEET_COST = 4.0
#: Words of the vocabulary and their most letters.
VOCABULARY, WORD_LETTERS = 20_000, 24
#: What a word costs that is not of the vocabulary, beside its letters.
OTHER_COST = 2.0
#: What a space costs that is not written.
GLUE_COST = 5.0
#: Letters of the longest token whose words are remembered.
CACHE_LETTERS = 80
#: Words up to so many letters are split as columns of a matrix, so many at once;
#: longer ones one by one, with the same result.
MATRIX_LETTERS, MATRIX_ROWS = 40, 8_000
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

# The alphabet of the character model: letters by number, 0 for everything else.
_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ"
SYMBOLS = len(_LETTERS) + 1
_NUMBER = {c: i + 1 for i, c in enumerate(_LETTERS)}
_CODE = np.zeros(0x10000, np.int64)
for _c, _i in _NUMBER.items():
    _CODE[ord(_c)] = _i
    if len(_c.upper()) == 1:
        _CODE[ord(_c.upper())] = _i

_PLAIN = re.compile(r"[^\w@$!|+(<€]*([^\W\d_]+)[^\w@$!|+(<€]*")
_RUN = re.compile(r"(.)\1\1")
# digits with their unit or with emphasis; what else stands behind a word
_AMOUNT = re.compile(r"\d+(?:!+|[$+|€]?)")
_TAIL = re.compile(r"[^\w@$!|+(<€]+\Z")
# letters or signs alone, one sign apart; no part of a word on either side
_ALONE = r"(?:[^\W_]|[@$!|+(<€])(?![^\W_]|[^\w\s.\-*][^\W_])"
_PIECE = re.compile(r"(?:[^\W_]|[@$!|+(<€])+")
_SPACED = re.compile(rf"(?<![^\W_])(?<![^\W_][^\w\s]){_ALONE}(?:[ .\-_*]{_ALONE}){{2,}}+")
# kinds of signs
_SPACE, _LETTER, _DIGIT, _SIGN, _LINE, _GAP = 1, 2, 4, 8, 16, 32


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return _CODE[np.where(points < len(_CODE), points, 0)]


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of character trigrams over every text of ``docs``.

    The result has a fixed number of entries, whatever the input's size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            # two blanks end a text and begin the next: no trigram spans two texts
            for part in slices(batch.column(0).to_pylist(), COUNT_CHARS):
                c = _codes(f"  {'  '.join(part)}  ")
                total += np.bincount(c[:-2] * SYMBOLS**2 + c[1:-1] * SYMBOLS + c[2:], minlength=SYMBOLS**3)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["gram", "n"])

    rows = (
        docs.select(text).mapInArrow(run, "gram long, n long")
        .groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    )
    counts = np.zeros(SYMBOLS**3)
    counts[rows["gram"].to_numpy(np.int64)] = rows["n"].to_numpy(np.float64)
    return counts


class Speller:
    """Viterbi search over character lattices under a trigram model."""

    def __init__(self, counts: np.ndarray):
        tri = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        bi, uni = tri.sum(0), tri.sum((0, 1)) + 1.0
        p1 = uni / uni.sum()
        p2 = (bi + 5 * p1) / (bi.sum(1, keepdims=True) + 5)
        p3 = (tri + 5 * p2[None]) / (tri.sum(2, keepdims=True) + 5)
        self.table = (-np.log(p3)).ravel()
        self._cost = self.table.tolist()

    def costs(self, word: str) -> list[float]:
        """Negative log probability of the letters before each place, and of the word."""
        x = y = 0
        out = [0.0]
        for c in word:
            z = _NUMBER.get(c, 0)
            out.append(out[-1] + self._cost[(x * SYMBOLS + y) * SYMBOLS + z])
            x, y = y, z
        out[-1] += self._cost[(x * SYMBOLS + y) * SYMBOLS]
        return out

    def _lattice(self, token: str, at: int = 0) -> list[list[tuple[str, float]]]:
        """Per run of equal signs from ``at`` on, the spellings it may stand for with costs."""
        out, word = [], len(token)
        while word and not token[word - 1].isalnum():
            word -= 1
        # plain letters stay; only the signs behind them are open
        plain = token[:word].isalpha() and not _RUN.search(token[:word])
        while at < len(token):
            c, to = token[at], at
            while to < len(token) and token[to] == c:
                to += 1
            n = to - at
            options = [(x, LEET_COST) for x in LEET.get(c, "")]
            if c in _NUMBER or c.isalpha():
                options.append((c, 0.0))
                if plain:
                    options = [(c * n, 0.0)]
                elif n == 2:
                    options = [(c + c, 0.0), (c, SKIP_LEET_COST)]
                elif n > 2:
                    options = [(c, FOLD_COST), (c + c, FOLD_COST), (c * min(n, 8), KEEP_RUN_COST)]
            else:
                if n > 1:
                    options += [(x + x, LEET_COST) for x in LEET.get(c, "")]
                skip = SKIP_LEET_COST if at < word else END_COST.get(c, END_LEET_COST)
                options.append(("", skip if c in LEET else SKIP_COST))
                options.append((c, KEEP_SIGN_COST))
                if c not in LEET and at:
                    options.append((" ", SKIP_COST))
            out.append(options)
            at = to
        return out

    def restore(self, token: str) -> str:
        """Likeliest spelling of a lower-case token; several words with spaces."""
        # a spelling is a chain of its parts, so a step does not copy what came before
        beams: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        cost, word = self._cost, len(token)
        while word and not token[word - 1].isalnum():
            word -= 1
        if token[:word].isalpha() and not _RUN.search(token[:word]):
            # plain letters have one spelling; only the signs behind them are open
            x, y, total = 0, 0, 0.0
            for c in token[:word]:
                z = _NUMBER.get(c, 0)
                total += cost[(x * SYMBOLS + y) * SYMBOLS + z]
                x, y = y, z
            beams = {(x, y): (total, (None, token[:word]))}
        else:
            word = 0
        for options in self._lattice(token, word):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (paid, chain) in beams.items():
                for letters, price in options:
                    x, y, total = a, b, paid + price
                    for c in letters:
                        z = _NUMBER.get(c, 0)
                        total += cost[(x * SYMBOLS + y) * SYMBOLS + z]
                        x, y = y, z
                    if (x, y) not in new or total < new[x, y][0]:
                        new[x, y] = (total, (chain, letters))
            beams = new
        ends = ((paid + cost[(a * SYMBOLS + b) * SYMBOLS], chain) for (a, b), (paid, chain) in beams.items())
        chain, parts = min(ends, key=lambda e: e[0])[1], []
        while chain is not None:
            chain, letters = chain
            parts.append(letters)
        return "".join(reversed(parts))


class Reader:
    """Restored words of whole texts; remembers a bounded number of spellings.

    Tokens of up to ``CACHE_LETTERS`` letters are found by 64-bit hashes.
    """

    def __init__(self, speller: Speller, words: dict[str, float]):
        self._speller = speller
        self._words = words
        self._parted: dict[str, str] = {}
        self._forget()
        self._finder = ahocorasick.Automaton()
        for word, cost in words.items():
            self._finder.add_word(word, (len(word), cost))
        if words:
            self._finder.make_automaton()
        # hashes and costs of the words of each length, by hash, and the first bits of these hashes
        self._hashed: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        hashes, prices = Parts("\n".join(words)).hashes(end - size, end) * _MIX, np.array([*words.values()])
        for n in set(size.tolist()):
            same = np.nonzero(size == n)[0]
            same = same[np.argsort(hashes[same])]
            first = np.zeros(2**16, bool)
            first[hashes[same] >> np.uint64(48)] = True
            self._hashed[n] = (np.append(hashes[same], np.uint64(2**64 - 1)), np.append(prices[same], np.inf), first)

    def _forget(self) -> None:
        # restored tokens, which of them are several words, and where the hash of a token leads
        self._read: list[str] = []
        self._several = np.empty(0, bool)
        self._keys, self._number = np.empty(0, np.uint64), np.empty(0, np.int32)
        self._spaced: dict[str, str] = {}

    def _readings(self, token: str) -> list[str]:
        """Spellings of a token, the likeliest first: as one run of signs and,
        where signs part it, piece by piece."""
        plain = _PLAIN.fullmatch(token)
        if plain and not _RUN.search(plain[1]):
            return [self._unglued(plain[1])]
        core = _TAIL.sub("", token)
        if not any(c.isalnum() for c in core) or _AMOUNT.fullmatch(core):
            return []
        whole = " ".join(map(self._unglued, self._speller.restore(core).split()))
        pieces = _PIECE.findall(core)
        if len(pieces) < 2:
            return [whole]
        apart = " ".join(filter(None, map(self._spell, pieces)))
        # a sign that the whole leaves out stands for a space that is not there
        out = max(0, len(pieces) - len(whole.split())) * GLUE_COST
        return [whole, apart] if self._price(whole) + out <= self._price(apart) else [apart, whole]

    def _spell(self, token: str) -> str:
        return next(iter(self._readings(token)), "")

    def _price(self, words: str) -> float:
        get, costs = self._words.get, self._speller.costs
        return sum(OTHER_COST + costs(w)[-1] if (known := get(w)) is None else known for w in words.split())

    def _unglued(self, letters: str) -> str:
        """The letters as one word, or as the words that they likelier are.

        Among splits of one cost the one with longer last words stays.
        """
        if letters in self._words or not self._words:
            return letters
        known = self._parted.get(letters)
        if known is None:
            known = self._split(letters)
            if len(letters) <= CACHE_LETTERS:
                self._parted[letters] = known
        return known

    def _unglue_all(self, words: set[str]) -> None:
        """Remember ``_unglued`` of many words, as ``_split`` finds it, a letter of all at once."""
        out: dict[str, str] = {}
        rows = sorted(words, key=len, reverse=True) if self._words else []
        long = sum(len(w) > MATRIX_LETTERS for w in rows)
        out.update((w, several) for w in rows[:long] if " " in (several := self._split(w)))
        for at in range(long, len(rows), MATRIX_ROWS):
            self._split_rows(rows[at : at + MATRIX_ROWS], out)
        self._parted.update(zip(words, words, strict=True))
        self._parted.update(out)

    def _split_rows(self, words: list[str], out: dict[str, str]) -> None:
        """Splits of words, the longest first."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        # two blanks before each word: its letters are priced as those of a word alone
        parts = Parts("\n\n" + "\n\n".join(words) + "\n")
        c = _CODE[np.where(parts.points < len(_CODE), parts.points, 0)]
        costs = self._speller.table[(c[:-2] * SYMBOLS + c[1:-1]) * SYMBOLS + c[2:]]
        begins = np.cumsum(size + 2) - size  # costs[begins[i] - 2] is that of the first letter
        # words that have at least so many letters
        alive = len(words) - np.searchsorted(size[::-1], np.arange(size[0] + 2))
        row, at, end, price = self._parts_of(parts, begins, size, alive)
        order = np.argsort((end * (MATRIX_LETTERS + 1) + at).astype(np.int16), kind="stable")
        row, at, end, price = row[order], at[order], end[order], price[order]
        cuts = np.nonzero(np.diff(end, prepend=-1) | np.diff(at, prepend=-1))[0].tolist()
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for i, j in itertools.pairwise([*cuts, len(row)]):
            groups.setdefault(int(end[i]), []).append((int(at[i]), i, j))
        # a line of each array holds one place of all words
        best, start = np.empty((size[0] + 1, len(words))), np.zeros((size[0] + 1, len(words)), np.int8)
        best[0] = -GLUE_COST
        cheapest, since, spelled = np.full(len(words), np.inf), np.zeros(len(words), np.int8), np.zeros(len(words))
        for e in range(1, size[0] + 1):
            k, ended = alive[e], alive[e + 1]
            begun = best[e - 1, :k] + GLUE_COST + OTHER_COST - spelled[:k]
            new = np.nonzero(begun < cheapest[:k])[0]
            cheapest[new], since[new] = begun[new], e - 1
            spelled[:k] += costs[begins[:k] + (e - 3)]
            spelled[ended:k] += costs[begins[ended:k] + (e - 2)]
            paid, begin = cheapest[:k] + spelled[:k], since[:k].copy()
            for a, i, j in groups.get(e, ()):
                total = best[a, row[i:j]] + GLUE_COST + price[i:j]
                better = total < paid[row[i:j]]
                paid[row[i:j][better]], begin[row[i:j][better]] = total[better], a
            best[e, :k], start[e, :k] = paid, begin
        for i in np.nonzero(start[size, np.arange(len(words))])[0].tolist():
            found, e = [], len(words[i])
            while e:
                found.append(words[i][start[e, i] : e])
                e = int(start[e, i])
            out[words[i]] = " ".join(reversed(found))

    def _parts_of(
        self, parts: Parts, begins: np.ndarray, size: np.ndarray, alive: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where words of the vocabulary stand in words: the word's number, start and end in it, and cost."""
        down, found = parts.down * _MIX, []
        for n, (keys, prices, first) in self._hashed.items():
            if n > size[0]:
                continue
            last = int(alive[n]) - 1
            stop = int(begins[last] + size[last]) + 1
            sought = (parts.sums[n:stop] - parts.sums[: stop - n]) * down[: stop - n]
            hit = np.nonzero(first[(sought >> np.uint64(48)).view(np.int64)])[0]
            place = np.searchsorted(keys, sought[hit])
            same = (keys[place] == sought[hit]) & (place < len(keys) - 1)
            found.append((hit[same], np.full(same.sum(), n), prices[place[same]]))
        at, n, price = map(np.concatenate, zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        row = np.searchsorted(begins, at, "right") - 1
        at = at - begins[row]
        return row, at, at + n, price

    def _split(self, letters: str) -> str:
        spelled = self._speller.costs(letters)
        found: dict[int, list[tuple[int, float]]] = {}  # words of the vocabulary by their end
        for last, (n, cost) in self._finder.iter(letters):
            # one that costs more than its letters as no word is never a part
            if cost < OTHER_COST + spelled[last + 1] - spelled[last + 1 - n]:
                found.setdefault(last + 1, []).append((last + 1 - n, cost))
        if not found:
            return letters
        # cost and start of the last part of the best split up to each letter
        best, start = [-GLUE_COST], [0]
        cheapest, since = float("inf"), 0  # of a stretch that is no word: where it begins best
        for end in range(1, len(letters) + 1):
            begun = best[-1] + GLUE_COST + OTHER_COST - spelled[end - 1]
            if begun < cheapest:
                cheapest, since = begun, end - 1
            paid, begin = cheapest + spelled[end], since
            for at, cost in found.get(end, ()):
                if best[at] + GLUE_COST + cost < paid:
                    paid, begin = best[at] + GLUE_COST + cost, at
            best.append(paid)
            start.append(begin)
        parts, end = [], len(letters)
        while end:
            parts.append(letters[start[end] : end])
            end = start[end]
        return " ".join(reversed(parts))

    def _joined(self, letters: str) -> str:
        """Spaced letters, read as one token."""
        # mostly signs: a formula or a rule
        if letters.isdigit() or 2 * sum(c.isalnum() for c in letters) < len(letters):
            return ""
        return " ".join(map(self._unglued, self._speller.restore(letters).split()))

    def text(self, text: str | None) -> str:
        """The text word by word as restored."""
        low, out, at = (text or "").lower(), [], 0
        for m in _SPACED.finditer(low):
            out += [*map(self._spell, low[at : m.start()].split()), self._joined(m[0][::2])]
            at = m.end()
        return " ".join(filter(None, [*out, *map(self._spell, low[at:].split())]))

    def words_of(self, texts: Iterable[str | None]) -> Iterator[set[str]]:
        """Distinct words of each restored text."""
        for part in slices(texts, READ_CHARS):
            yield from self._words_of_part([t.lower() for t in part])

    def words(self, text: str | None) -> set[str]:
        return next(self.words_of([text]))

    def _words_of_part(self, texts: list[str]) -> Iterator[set[str]]:
        if len(self._read) > CACHE_WORDS:
            self._forget()
        if len(self._parted) > CACHE_PARTED:
            self._parted.clear()
        joined = "\n".join(texts)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        kinds = _kinds()[points]
        start, end, plain = _tokens(points, kinds)
        bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
        beyond = end - start > CACHE_LETTERS
        long: dict[int, list[str]] = {}
        for i, j in zip(start[beyond].tolist(), end[beyond].tolist(), strict=True):
            words = " ".join(self._readings(joined[i:j])).split()
            long.setdefault(int(np.searchsorted(bounds, i, "right")) - 1, []).extend(words)
        start, end, plain = start[~beyond], end[~beyond], plain[~beyond]
        found, first, of = _distinct(word_hashes(points, start, end - start))
        place = np.searchsorted(self._keys, found)
        old = place < len(self._keys)
        old[old] = self._keys[place[old]] == found[old]
        new, number = first[~old], np.empty(len(found), np.int32)
        number[old] = self._number[place[old]]
        number[~old] = np.arange(len(self._read), len(self._read) + len(new))
        tokens = [joined[i:j] for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)]
        more = self._read_tokens(tokens, plain[new].tolist())
        self._read += more
        self._several = np.append(self._several, [" " in t for t in more]).astype(bool)
        self._keys = np.insert(self._keys, place[~old], found[~old])
        self._number = np.insert(self._number, place[~old], number[~old])
        # every token once a text, those of one word before those of several
        doc = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, bounds)))
        held = np.sort(doc * len(self._read) + number[of])
        doc, at = np.divmod(held[np.diff(held, prepend=-1) > 0], max(1, len(self._read)))
        several = self._several[at]
        every = np.arange(len(texts) + 1)
        one, glued = ((at[x].tolist(), np.searchsorted(doc[x], every).tolist()) for x in (~several, several))
        get = self._read.__getitem__
        spaced = set((np.searchsorted(bounds, _maybe_spaced(kinds), "right") - 1).tolist())
        for i, text in enumerate(texts):
            out = set(map(get, one[0][one[1][i] : one[1][i + 1]]))
            out.update(*map(str.split, map(get, glued[0][glued[1][i] : glued[1][i + 1]])), long.get(i, ()))
            if i in spaced:
                out.update(*(self._words_of_spaced(run[::2]) for run in _SPACED.findall(text)))
            out.discard("")
            yield out

    def _words_of_spaced(self, letters: str) -> list[str]:
        """Words of spaced letters, as a token and as words of their own."""
        known = self._spaced.get(letters)
        if known is None:
            plain = _PLAIN.fullmatch(letters)
            if plain and len(letters) < CACHE_LETTERS and not _RUN.search(plain[1]):
                known = self._unglued(plain[1])
            else:
                known = " ".join([*self._readings(letters), self._joined(letters)])
            if len(letters) <= CACHE_LETTERS and len(self._spaced) < CACHE_PARTED:
                self._spaced[letters] = known
        return known.split()

    def _read_tokens(self, tokens: list[str], plain: list[bool]) -> list[str]:
        """Words of each token, a blank between any two; plain ones are letters only."""
        known, parted = self._words, self._parted
        self._unglue_all({t for t, p in zip(tokens, plain, strict=True) if p and t not in known and t not in parted})
        return [
            parted.get(t, t) if p else " ".join(self._readings(t)) for t, p in zip(tokens, plain, strict=True)
        ]


class Parts:
    """Hashes of parts of a text, modulo 2^64: the sum of its signs' numbers by powers of the place."""

    def __init__(self, text: str):
        self.points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        up, self.down = _powers(1 << len(text).bit_length())
        self.sums = np.zeros(len(self.points) + 1, np.uint64)
        np.cumsum((self.points + np.uint64(1)) * up[: len(self.points)], out=self.sums[1:])

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    return tuple(
        np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, x, np.uint64)]))
        for x in (_BASE, np.uint64(pow(int(_BASE), -1, 2**64)))
    )


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@cache
def _kinds() -> np.ndarray:
    """Bits of each sign: white space, letters, digits and so on."""
    every = np.arange(0x110000, dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    out = np.zeros(0x110000, np.uint8)
    for bit, kind in (
        (_SPACE, r"\s+"), (_LETTER, r"[^\W\d_]+"), (_DIGIT, r"\d+"), (_SIGN, r"[@$!|+(<€]"), (_LINE, "_"), (_GAP, r"[ .\-_*]")
    ):
        for m in re.finditer(kind, every):
            out[m.start() : m.end()] |= bit
    return out


def _tokens(points: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where tokens start and end, and which are plain: of these the letters alone,
    without the signs around them (``_PLAIN`` without ``_RUN``)."""
    start, end = _runs(kinds & _SPACE == 0)
    first, last = _runs(kinds & _LETTER != 0)
    opened = np.zeros(len(points) + 1, np.int32)
    np.cumsum(kinds & (_DIGIT | _SIGN | _LINE) != 0, out=opened[1:])
    begun = np.zeros(len(points) + 1, np.int32)
    begun[first + 1] = 1
    np.cumsum(begun, out=begun)
    plain = (opened[start] == opened[end]) & (begun[end] - begun[start] == 1)
    run = begun[start[plain]]
    first, last = first[run], last[run]
    thrice = np.nonzero((points[2:] == points[1:-1]) & (points[1:-1] == points[:-2]))[0]
    same = np.searchsorted(thrice, first) < np.searchsorted(thrice, last - 2)
    plain[plain] = ~same
    start[plain], end[plain] = first[~same], last[~same]
    return start, end, plain


def _maybe_spaced(kinds: np.ndarray) -> np.ndarray:
    """Places of two letters or signs alone, one of which stands in every run of spaced letters."""
    gap, alone = kinds & _GAP != 0, kinds & (_LETTER | _DIGIT | _SIGN) != 0
    word = np.append(kinds[4:] & (_LETTER | _DIGIT) != 0, False)
    n = len(kinds) - 3
    return np.nonzero(gap[:n] & alone[1 : n + 1] & gap[2 : n + 2] & alone[3:] & ~word)[0] if n > 0 else np.empty(0, int)


def _runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of true places start and end."""
    edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    return np.nonzero(edges == 1)[0], np.nonzero(edges == -1)[0]


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, the first place of each, and of every place the number of its hash."""
    of, found = pd.factorize(hashes)
    first, number, order = np.empty(len(found), np.int64), np.empty(len(found), np.int64), np.argsort(found)
    first[of[::-1]] = np.arange(len(of))[::-1]
    number[order] = np.arange(len(found))
    return found[order], first[order], number[of]


def _once(doc: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the first of equal hashes of a document."""
    return np.nonzero(~pd.Series(hashes ^ (doc.astype(np.uint64) * _MIX)).duplicated().to_numpy())[0]


class Tally:
    """Numbers of words, added up by the words' hashes; the text of a word is kept once."""

    def __init__(self, columns: int):
        self._columns = columns
        self._forget()

    def _forget(self) -> None:
        self._keys, self._row = np.empty(0, np.uint64), np.empty(0, np.int32)
        self._words: list[str] = []
        self._numbers = np.empty((0, self._columns), np.int64)

    def add(self, text: str, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, *numbers: np.ndarray) -> None:
        """``hashes`` in order, none twice; of each, where its word stands and its numbers."""
        place, given = np.searchsorted(self._keys, hashes), np.stack(numbers, axis=1)
        old = place < len(self._keys)
        old[old] = self._keys[place[old]] == hashes[old]
        self._numbers[self._row[place[old]]] += given[old]
        new = ~old
        rows = np.arange(len(self._words), len(self._words) + new.sum(), dtype=np.int32)
        self._row, self._keys = np.insert(self._row, place[new], rows), np.insert(self._keys, place[new], hashes[new])
        self._words += [text[i:j] for i, j in zip(start[new].tolist(), end[new].tolist(), strict=True)]
        self._numbers = np.concatenate([self._numbers, given[new]])

    def full(self) -> bool:
        return len(self._words) > TALLY_WORDS

    def taken(self, *names: str) -> dict[str, pa.Array]:
        """The words and their numbers as columns; the tally begins anew."""
        out = [pa.array(self._words, pa.string()), *map(pa.array, self._numbers.T.copy())]
        self._forget()
        return dict(zip(names, out, strict=True))


def _features(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features of texts that ``words`` gave: words with a blank behind and
    beginnings of words. All texts joined, and per feature its text, hash, start and
    end; a beginning comes once per word that has it."""
    text = " ".join(texts) + " "
    parts = Parts(text)
    start, end = _runs(parts.points != ord(" "))
    doc = np.repeat(np.arange(len(texts)), [t.count(" ") + 1 if t else 0 for t in texts])
    found = [(doc, start, end + 1)]
    for n in PREFIXES:
        long = end - start >= n
        found.append((doc[long], start[long], start[long] + n))
    doc, start, end = map(np.concatenate, zip(*found, strict=True))
    return text, doc, parts.hashes(start, end), start, end


class Holder:
    """Which of some features texts hold."""

    def __init__(self, features: Iterable[str]):
        hashes = [Parts(f).hashes(np.array([0]), np.array([len(f)]))[0] for f in features]
        order = np.argsort(np.array(hashes, np.uint64))
        self._order = np.append(order, 0)
        self._keys = np.append(np.array(hashes, np.uint64)[order], np.uint64(2**64 - 1))
        self._first = np.zeros(2**16, bool)
        self._first[self._keys[:-1] >> np.uint64(48)] = True

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of texts that ``words`` gave and of the features that they hold, in order."""
        _, doc, hashes, _, _ = _features(texts)
        maybe = np.nonzero(self._first[(hashes >> np.uint64(48)).view(np.int64)])[0]
        doc, hashes = doc[maybe], hashes[maybe]
        place = np.searchsorted(self._keys, hashes)
        same = (self._keys[place] == hashes) & (place < len(self._keys) - 1)
        held = np.sort(doc[same] * len(self._keys) + self._order[place[same]])
        return np.divmod(held[np.diff(held, prepend=-1) > 0], len(self._keys))


@dataclass
class Model:
    counts: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    words: dict[str, float] = field(default_factory=dict)

    def reader(self) -> Reader:
        return Reader(Speller(self.counts), self.words)

    def scorer(self) -> Callable[[list[str]], list[float]]:
        """Scores of texts that ``words`` gave."""
        holder, weights = Holder(self.weights), np.array([*self.weights.values(), 0.0])

        def run(texts: list[str]) -> list[float]:
            doc, held = holder.of(texts)
            z = self.bias + np.bincount(doc, weights[held], len(texts))
            return (1 / (1 + np.exp(-np.clip(z, -60, 60)))).tolist()

        return run


def _least(documents: int) -> int:
    return max(LEAST_DOCUMENTS, math.ceil(documents * LEAST_SHARE))


def vocabulary(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """The words of the most documents of ``docs`` with their costs in a split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally(1)
        for batch in batches:
            for texts in slices(batch.column(0).to_pylist(), READ_CHARS):
                joined = " ".join(texts)
                points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
                start, end = _runs(_is_letter()[points])
                short = end - start <= WORD_LETTERS
                start, end = start[short], end[short]
                ends = np.cumsum([len(t) + 1 for t in texts])
                hashes = word_hashes(points, start, end - start)
                once = _once(np.searchsorted(ends, start, "right"), hashes)
                keys, at, of = _distinct(hashes[once])
                tally.add(joined, keys, start[once[at]], end[once[at]], np.bincount(of, minlength=len(keys)))
                if tally.full():
                    yield pa.RecordBatch.from_pydict(tally.taken("w", "n"))
        yield pa.RecordBatch.from_pydict(tally.taken("w", "n"))

    rows = (
        docs.select(F.lower(F.col(text))).mapInArrow(run, "w string, n long")
        .groupBy("w").agg(F.sum("n").alias("n")).where(f"n >= {_least(docs.count())}")
        .orderBy(F.desc("n"), "w").limit(VOCABULARY).toPandas()
    )
    costs = -np.log(rows["n"].to_numpy(np.float64) / max(1, rows["n"].sum()))
    return dict(zip(rows["w"], costs.tolist(), strict=True))


def spelling(docs: DataFrame, text: str = "text") -> Model:
    """Character counts and vocabulary of every text, as yet without a score."""
    return Model(trigram_counts(docs, text), words=vocabulary(docs, text))


def words(model: Model, text: Column) -> Column:
    """Distinct words of the restored text in order, a blank between any two."""

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = model.reader()
        for part in parts:
            read = [" ".join(sorted(w)) for w in reader.words_of(part)]
            yield pd.Series(read, index=part.index, dtype="object")

    return run(text)


def learn(model: Model, read: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """Fit the score on all rows of ``read`` (doc_id, words) that have a label and
    are not held out."""
    ids = labelled_ids(labels, "toxic", held_out)
    read = read.select(F.col("doc_id").cast("long").alias("doc_id"), "words").where(~held_out)
    # of rows that repeat an id, one stays: that of least words
    rows = (
        maybe_among(read, ids, "doc_id").join(ids, "doc_id")
        .groupBy("doc_id").agg(F.min(F.struct("y", "words")).alias("r")).select("r.*")
    )
    rows = staged(rows, "toxicity-labelled", "zstd")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    share = n1 / (n0 + n1) if n0 + n1 else 0.5
    model.bias = float(np.log((share + 1e-9) / (1 - share + 1e-9)))
    if not n0 or not n1:
        return model

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tally = Tally(2)
        for part in batches:
            at = 0
            for texts in slices(part["words"], COUNT_CHARS):
                y = part["y"].to_numpy()[at : at + len(texts)]
                at += len(texts)
                joined, doc, hashes, start, end = _features(texts)
                once = _once(doc, hashes)
                keys, first, of = _distinct(hashes[once])
                n1, n = np.bincount(of, y[doc[once]], len(first)).astype(np.int64), np.bincount(of, minlength=len(first))
                first = once[first]
                tally.add(joined, keys, start[first], end[first], n - n1, n1)
                if tally.full():
                    yield pd.DataFrame(tally.taken("f", "n0", "n1"))
        yield pd.DataFrame(tally.taken("f", "n0", "n1"))

    odds = F.log(((F.col("n1") + 0.5) / (n1 + 1.0)) / ((F.col("n0") + 0.5) / (n0 + 1.0)))
    chosen = (
        rows.mapInPandas(count, "f string, n0 long, n1 long")
        .groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(f"n0 + n1 >= {_least(n0 + n1)}")
        .orderBy(F.abs(odds * (F.col("n0") / float(n0) - F.col("n1") / float(n1))).desc(), "f")
        .limit(FEATURES).select("f").toPandas()["f"].tolist()
    )
    if not chosen:
        return model

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        holder = Holder(chosen)
        for part in batches:
            x = []
            for texts in slices(part["words"], COUNT_CHARS):
                doc, held = holder.of(texts)
                x += np.split(held.astype(np.int32), np.searchsorted(doc, np.arange(1, len(texts))))
            yield pd.DataFrame({"y": part["y"], "x": x})

    # copies of a document are one example
    examples = rows.mapInPandas(hold, "y int, x array<int>").distinct().sortWithinPartitions("y", "x")
    examples = staged(examples, "toxicity-examples").select("y", F.col("x").cast("array<string>").alias("x"))
    vectors = CountVectorizerModel.from_vocabulary([str(i) for i in range(len(chosen))], "x", "held")
    # Spark's loss is the mean, without a change of scale
    fitted = LogisticRegression(
        featuresCol="held", labelCol="y", regParam=PENALTY / examples.count(), standardization=False, maxIter=STEPS
    ).fit(vectors.setBinary(True).transform(examples))
    # the order in which sums of tasks arrive moves the last digits
    w = np.round(fitted.coefficients.toArray(), 6)
    model.bias = round(float(fitted.intercept), 6)
    model.weights = {f: float(x) for f, x in zip(chosen, w, strict=True) if x}
    return model


def fit(docs: DataFrame, labels: DataFrame, held_out: Column) -> Model:
    """Spelling from all texts; the score from all labelled rows not held out."""
    model = spelling(docs)
    read = docs.select("doc_id", words(model, F.col("text")).alias("words"))
    return learn(model, read, labels, held_out)


def scored(
    docs: DataFrame, labels: DataFrame, held_out: Column, score: str = "score", keep: list[str] | None = None
) -> DataFrame:
    """The columns ``keep`` (default: all) of ``docs`` and the score of each row.

    Every text is restored once: its words are staged beside the columns that
    stay, for the fit and for the score.
    """
    model = spelling(docs)
    keep = docs.columns if keep is None else keep
    name = "_" * max(map(len, keep)) + "words"
    read = docs.select(*keep, words(model, F.col("text")).alias(name))
    read = staged(read, "toxicity-words", "zstd")
    learn(model, read.select("doc_id", F.col(name).alias("words")), labels, held_out)
    return read.withColumn(score, score_of_words(model, F.col(name))).drop(name)


def score_of_words(model: Model, restored_words: Column) -> Column:
    """Score between 0 and 1 of a column that ``words`` gave."""

    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scores = model.scorer()
        for part in parts:
            found = [x for texts in slices(part, COUNT_CHARS) for x in scores(texts)]
            yield pd.Series(found, index=part.index, dtype="float64")

    return run(restored_words)


def score(model: Model, text: Column) -> Column:
    """Score between 0 and 1 of a text column; higher: label 1 likelier."""

    @F.pandas_udf(T.DoubleType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader, scores = model.reader(), model.scorer()
        for part in parts:
            read = (" ".join(sorted(w)) for w in reader.words_of(part))
            found = [x for texts in slices(read, COUNT_CHARS) for x in scores(texts)]
            yield pd.Series(found, index=part.index, dtype="float64")

    return run(text)


def restored(model: Model, text: Column) -> Column:
    """The text with disguised words spelled out (white space becomes one space)."""

    @F.pandas_udf(T.StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        reader = model.reader()
        for part in parts:
            yield pd.Series([reader.text(t) for t in part], index=part.index, dtype="object")

    return run(text)

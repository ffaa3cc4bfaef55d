"""Fill-in-middle: texts cut in three and reordered around sentinels.

A text is a sequence of units, ``[A-Za-z]+`` or any single other code point.
Which unit a cut falls on comes from a hash of the document's id; where that
unit begins is found with a wavelet matrix over character classes (white
space, other sign, first letter of a run, further letter). Every class but the
last begins a unit, so the number of units before a place is the sum of three
rank queries, and a place is found from a number of units by bisection on the
ranks, for all texts of a batch at once. Only counts and places leave Python;
the texts are cut and joined by Spark.

Output: ``plain`` the text itself; ``psm`` ``<P>``prefix``<S>``suffix``<M>``middle;
``spm`` ``<S>``suffix``<P>``prefix``<M>``middle. A text that is empty or holds a
sentinel stays plain, so ``restore`` can split at the sentinels: none of them
can arise where two parts meet, as none begins with the end of another.

Semantics: a null text is empty; a null id is hashed as the empty text. Equal
ids give equal draws, applied to each row's own text. Texts are taken whole;
beside a text of any length stand at most about ten bytes a character. Empty tables
give no rows. Columns that are added replace columns of the same name; all
others are carried along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import slices

SPACE, SIGN, FIRST, FURTHER = range(4)
_BEGIN = (SPACE, SIGN, FIRST)
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


class BitVector:
    """Bits with the count of ones before any place in constant time."""

    def __init__(self, bits: np.ndarray):
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        packed = np.packbits(bits, bitorder="little")
        self.words.view(np.uint8)[: len(packed)] = packed
        ones = np.cumsum(np.bitwise_count(self.words), dtype=np.int64)
        self.before = np.concatenate([[0], ones[:-1]])
        self.zeros = len(bits) - int(ones[-1])

    def ones(self, stop: np.ndarray) -> np.ndarray:
        word = stop >> 6
        mask = (np.uint64(1) << (stop & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask)


class WaveletMatrix:
    """Rank queries over a sequence of small symbols, one bit vector a bit."""

    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitVector]] = []
        for bit in reversed(range(bits)):
            on = (symbols >> bit & 1).astype(bool)
            self.levels.append((bit, BitVector(on)))
            if bit:
                symbols = np.concatenate([symbols[~on], symbols[on]])

    def rank(self, symbol: int, stop: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs before each place of ``stop``."""
        start = np.zeros_like(stop)
        for bit, level in self.levels:
            low, high = level.ones(start), level.ones(stop)
            if symbol >> bit & 1:
                start, stop = level.zeros + low, level.zeros + high
            else:
                start, stop = start - low, stop - high
        return stop - start


def classes(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Character class of every code point; a run of letters ends where a text does."""
    lower = points | 32
    letter = (lower >= ord("a")) & (lower <= ord("z"))
    further = letter.copy()
    further[1:] &= letter[:-1]
    further[starts[starts < len(points)]] = False
    space = (points == 32) | ((points >= 9) & (points <= 13))
    out = np.full(len(points), SIGN, np.uint8)
    out[space] = SPACE
    out[letter] = FIRST
    out[further] = FURTHER
    return out


class Units:
    """The units of several texts laid end to end."""

    def __init__(self, texts: list[str]):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.stops = np.cumsum(sizes)
        self.starts = self.stops - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.matrix = WaveletMatrix(classes(points, self.starts), 2)
        self.base = self.begun(self.starts)

    def begun(self, place: np.ndarray) -> np.ndarray:
        """Units that begin before each place."""
        return sum(self.matrix.rank(symbol, place) for symbol in _BEGIN)

    def counts(self) -> np.ndarray:
        return self.begun(self.stops) - self.base

    def places(self, units: np.ndarray) -> np.ndarray:
        """Code points of each text before its unit number ``units``.

        The last place with no more units begun than wanted, by bisection.
        """
        low, high, wanted = self.starts.copy(), self.stops.copy(), self.base + units
        while (low < high).any():
            mid = (low + high + 1) >> 1
            fits = self.begun(mid) <= wanted
            low, high = np.where(fits, mid, low), np.where(fits, high, mid - 1)
        return low - self.starts


def cuts(texts: list[str], one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: its units n, and the code points before the units
    ``one % (n + 1)`` and ``other % (n + 1)``, the lesser first."""
    units = Units(texts)
    n = units.counts()
    a, b = one % (n + 1), other % (n + 1)
    return n, units.places(np.minimum(a, b)), units.places(np.maximum(a, b))


_PLACES = StructType([StructField(name, LongType()) for name in ("n", "head", "body")])


@F.pandas_udf(_PLACES)
def _cut(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, one, other in batches:
        done, found = 0, [np.zeros((3, 0), np.int64)]
        for part in slices(texts):
            span = slice(done, done + len(part))
            found.append(np.stack(cuts(part, one.to_numpy()[span], other.to_numpy()[span])))
            done += len(part)
        yield pd.DataFrame(dict(zip(_PLACES.names, np.concatenate(found, axis=1), strict=True)))


def draws(key: Column, seed: int = 1) -> list[Column]:
    """Four unsigned 32-bit draws: the first hex groups of sha256 of ``seed:key``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_middle(
    rows: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1, plain_pct: int = 10, spm_pct: int = 20
) -> DataFrame:
    """``rows`` with ``n``, ``form``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``plain_pct`` of the documents stay plain, ``spm_pct`` of the others put
    the suffix first. No shuffle: every row is handled by itself.
    """
    h1, h2, h3, h4 = draws(F.col(key), seed)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    plain = (whole == "") | (h3 % 100 >= 100 - plain_pct)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains(whole, F.lit(mark))
    form = F.when(plain, "plain").when(h4 % 100 < spm_pct, "spm").otherwise("psm")
    cut = rows.withColumns({"_cut": _cut(whole, h1, h2), "form": form})
    head, body = F.col("_cut.head"), F.col("_cut.body")
    prefix = F.substr(whole, F.lit(1), head.cast("int"))
    middle = F.substr(whole, (head + 1).cast("int"), (body - head).cast("int"))
    suffix = F.substr(whole, (body + 1).cast("int"))
    output = (
        F.when(F.col("form") == "plain", whole)
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    moved = F.col("form") != "plain"
    return cut.withColumns(
        {
            "n": F.col("_cut.n"),
            "prefix_chars": F.when(moved, head),
            "middle_chars": F.when(moved, body - head),
            "output": output,
        }
    ).drop("_cut")


def restore(output: Column, form: Column) -> Column:
    """The text from an output and its form."""
    body = F.substr(output, F.lit(len(PREFIX) + 1))

    def parts(between: str) -> tuple[Column, Column, Column]:
        """What comes before ``between``, up to the middle's mark, and after it."""
        rest = F.split_part(body, F.lit(between), F.lit(2))
        mark = F.lit(MIDDLE)
        return F.split_part(body, F.lit(between), F.lit(1)), F.split_part(rest, mark, F.lit(1)), F.split_part(rest, mark, F.lit(2))

    prefix, _, _ = parts(SUFFIX)
    _, suffix, middle = parts(SUFFIX)
    psm = F.concat(prefix, middle, suffix)
    suffix, prefix, middle = parts(PREFIX)
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(F.concat(prefix, middle, suffix))

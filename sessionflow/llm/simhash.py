"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint bit is set if it is set in over half the hashes of a text's
word shingles. Two fingerprints within ``max_bits`` differ in at most that
many of ``BLOCKS`` bit blocks, so they agree in at least two whole blocks:
every pair of blocks makes one bucket table with keys of about 25 bits, and
every pair of near fingerprints meets in some bucket. Buckets larger than
``TILE`` fingerprints are dealt out as pairs of tiles. Inside a tile pair the
fingerprints stand as vertical bit planes: one row's distances to 64 others
advance together in carry-save bit counters, and a row's words are abandoned
once all their counters exceed the radius. Each tile pair returns links that
connect what it found (a spanning forest), so no bucket emits all its pairs.

Semantics: a null or empty text has no words and fingerprint zero, linked
like any other. Repeated rows have equal fingerprints and one component. A
null id is never a component's name unless all its ids are null. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, dealt_in_tiles, salted_join, staged, whole_groups
from .components import components

BITS = 64
#: First and last bit of each block; any 3 differing bits spare two blocks.
BLOCKS = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))
#: Fingerprints of one side of a comparison.
TILE = 1024
#: Groups of up to this many rows are compared many at once.
SMALL = 64
#: Hashes whose bits are counted at once.
HASHES = 65_536
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of a whole text."""
    words = _WORD.findall((text or "").encode().translate(_ASCII_LOWER))
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(BITS, np.int64)
    last = len(words) - shingle + 1
    for at in range(0, last, HASHES):
        to = min(last, at + HASHES)
        spans = zip(starts[at:to].tolist(), ends[at + shingle - 1 : to + shingle - 1].tolist(), strict=True)
        hashes = np.array([digest(line[a:b], seed) for a, b in spans], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > last).tobytes(), "big")


def fingerprints(
    docs: DataFrame, shingle: int = 3, text: str = "text", id_col: str = "doc_id", keep=()
) -> DataFrame:
    """(doc_id, columns ``keep``, fp) per row; ``fp`` holds the 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t, shingle) for t in batch.column(0).to_pylist()]
            fp = pa.array(np.array(values, np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], fp], names)

    kept = docs.select(F.col(text).alias("_text"), F.col(id_col).cast("long").alias("doc_id"), *keep)
    names = [*kept.columns[1:], "fp"]
    fields = kept.schema.fields[1:]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", fp long"
    return kept.mapInArrow(run, schema)


def _planes(values: np.ndarray) -> np.ndarray:
    """Bit planes (BITS, words): bit i of 64 values in each word."""
    padded = np.zeros(-(-len(values) // 64) * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(bits.T.copy(), axis=1, bitorder="little").view(np.uint64)


def _above(count: np.ndarray, limit: int) -> np.ndarray:
    """Which of the bit-sliced counters exceed ``limit``."""
    above = np.zeros(count.shape[1], np.uint64)
    equal = ~above
    for c in range(len(count) - 1, -1, -1):
        if limit >> c & 1:
            equal = equal & count[c]
        else:
            above |= equal & count[c]
            equal = equal & ~count[c]
    return above


def near_pairs(left: np.ndarray, right: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with ``left[i]`` and ``right[j]`` at most ``max_bits`` bits apart.

    ``right`` stands as bit planes; a block is one row of ``left`` against one
    word of them, 64 distances. Carry-save counters of enough planes to hold
    ``max_bits`` add one plane of differing bits at a time, and what carries
    out of them stays in ``over``. Blocks whose 64 distances all exceed the
    radius are dropped after every eighth plane.
    """
    planes = _planes(right)
    ones = np.uint64(2**64 - 1)
    words = planes.shape[1]
    flip = np.where(_bits(left), ones, np.uint64(0))  # (BITS, rows)
    row = np.repeat(np.arange(len(left)), words)
    word = np.tile(np.arange(words), len(left))
    over = np.zeros(len(row), np.uint64)
    if tail := len(right) % 64:
        over[words - 1 :: words] = ones ^ np.uint64(2**tail - 1)  # past the end
    count = np.zeros((max(1, max_bits.bit_length()), len(row)), np.uint64)
    for bit in range(BITS):
        carry = planes[bit][word] ^ flip[bit][row]
        for c in range(len(count)):
            carry, count[c] = count[c] & carry, count[c] ^ carry
        over |= carry
        if bit % 8 == 7:
            live = np.nonzero((over | _above(count, max_bits)) != ones)[0]
            if len(live) < len(row):
                row, word, over, count = row[live], word[live], over[live], count[:, live]
            if not len(row):
                break
    near = ~(over | _above(count, max_bits))
    hits = np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    block, at = np.nonzero(hits)
    return row[block], word[block] * 64 + at


def _bits(values: np.ndarray) -> np.ndarray:
    """(BITS, values) booleans."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8)
    return np.unpackbits(raw, axis=1, bitorder="little").T.astype(bool)


def _small_groups(values: np.ndarray, group: np.ndarray, max_bits: int):
    """Near pairs inside many small groups of neighbouring rows.

    All pairs of rows ``d`` places apart are compared at once: their exclusive
    ors are the values, and the distance to zero is counted bit-sliced.
    """
    zero = np.zeros(1, np.uint64)
    found = []
    for d in range(1, SMALL):
        at = np.nonzero(group[d:] == group[:-d])[0]
        if not len(at):
            break
        _, hit = near_pairs(zero, values[at] ^ values[at + d], max_bits)
        found.append(np.stack([at[hit], at[hit] + d]))
    return np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index that each of ``n`` indices reaches over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            next_ = label[label]
            if (next_ == label).all():
                break
            label = next_
    return label


def _linked(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    """One link from each value to the least one it reaches over (a, b)."""
    label = forest(len(values), a, b)
    moved = np.nonzero((label != np.arange(len(values))) & (values[label] != values))[0]
    names = values.view(np.int64)
    return pd.DataFrame({"a": names[moved], "b": names[label[moved]]})


_PAIR = ["t", "k", "i", "j"]


def _compare(batches: Iterator[pd.DataFrame], max_bits: int) -> Iterator[pd.DataFrame]:
    """Links inside the tile pairs of a partition sorted by pair."""
    for part in whole_groups(batches, _PAIR):
        keys = part[_PAIR].to_numpy()
        new = np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)])
        values = part["fp"].to_numpy().view(np.uint64)
        first = part["first"].to_numpy()
        one_tile = (part["i"] == part["j"]).to_numpy()
        group = np.cumsum(new) - 1
        starts = np.append(np.nonzero(new)[0], len(part))
        sizes = np.diff(starts)
        small = np.nonzero((sizes[group] <= SMALL) & one_tile)[0]
        a, b = _small_groups(values[small], group[small], max_bits)
        yield _linked(values[small], a, b)
        for g in np.nonzero((sizes > SMALL) | ~one_tile[starts[:-1]])[0].tolist():
            at = np.arange(starts[g], starts[g + 1])
            left = at if one_tile[at[0]] else at[first[at]]
            right = at if one_tile[at[0]] else at[~first[at]]
            if len(left) and len(right):
                a, b = near_pairs(values[left], values[right], max_bits)
                yield _linked(values[at], left[a] - at[0], right[b] - at[0])


def near_links(fps: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within ``max_bits``."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the bucket tables cover 0 to 3 bits")

    def masked(block: int):
        low, high = BLOCKS[block]
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit(2 ** (high - low) - 1))

    tables = [
        F.struct(F.lit(t).alias("t"), F.shiftleft(masked(i), 16).bitwiseOR(masked(j)).alias("k"))
        for t, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))
    ]
    rows = fps.select("fp", F.inline(F.array(*tables)))
    return (
        dealt_in_tiles(rows, ["t", "k"], "fp", TILE)
        .repartition(*_PAIR)
        .sortWithinPartitions(*_PAIR)
        .mapInPandas(lambda parts: _compare(parts, max_bits), "a long, b long")
        .distinct()
    )


def near_groups(prints: DataFrame, max_bits: int = 3) -> DataFrame:
    """(fp, first) for every fingerprint of the stored rows (doc_id, text_hash, fp).

    ``first`` is the row (id, text_hash) of the least id, then least text
    hash, among all rows whose fingerprints are reachable by links; a null id
    is the largest.
    """
    per_fp = staged(
        prints.groupBy("fp").agg(
            F.min(
                F.struct(
                    F.col("doc_id").isNull().alias("unnamed"),
                    F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"),
                    "text_hash",
                )
            ).alias("first")
        ),
        "fingerprints",
    )
    found = staged(components(near_links(per_fp, max_bits)), "components")
    nodes = per_fp.join(found, per_fp["fp"] == found["node"])
    least = nodes.groupBy("component").agg(F.min("first").alias("first"))
    linked = salted_join(found, least, ["component"], ["node"]).select(
        F.col("node").alias("fp"), "first"
    )
    alone = per_fp.join(linked, "fp", "left_anti")
    return alone.unionByName(linked)


def _prints(docs: DataFrame, shingle: int, text: str, id_col: str) -> DataFrame:
    hashed = F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash")
    return staged(fingerprints(docs, shingle, text, id_col, [hashed]), "prints")


def near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    prints = _prints(docs, shingle, text, id_col)
    groups = near_groups(prints, max_bits)
    return salted_join(prints, groups, ["fp"], ["doc_id", "text_hash"]).select(
        "doc_id",
        "fp",
        F.when(~F.col("first.unnamed"), F.col("first.id")).alias("component_id"),
    )


def drop_near_duplicates(
    docs: DataFrame, shingle: int = 3, max_bits: int = 3, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """The rows of ``docs`` that stand first in their component, all columns kept.

    Exactly one row stays per component: the one of the least id, then of the
    least text hash; rows that repeat both are one row.
    """
    first = near_groups(_prints(docs, shingle, text, id_col), max_bits).select(
        F.col("first.id").alias("_first_id"), F.col("first.text_hash").alias("_first_hash")
    )
    keep = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"),
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_first_id"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_first_hash"),
    )
    key = ["_first_id", "_first_hash"]
    return keep.join(first.distinct(), key, "left_semi").dropDuplicates(key).select("_row.*")

"""Embedding near-duplicates through an inverted multi-index.

Two codebooks, one for each half of the unit vectors, form a product grid of
cells. Every vector lives in the cell of its two nearest codewords. As a
query it walks the grid by multi-sequence traversal, in order of the summed
squared distances, and stops at a margin beyond its nearest cell: the margin
is calibrated on a bounded sample so that pairs at and above the threshold
are visited with the target recall. Each vector length has codebooks of its
own, as fine as its vectors are many; where a length's sample is too small to
calibrate on, the margin has no end, and walks visit every cell. Visited candidates are verified by cosine
in double precision. A pair counts once, even if both sides visit each other.

Vectors are compared only within equal labels. Equal vectors are one class
with a weight, so copies are not expanded into pairs. A crowded cell is dealt
out as pairs of tiles, and a task returns link counts and a spanning forest
of its links, never the pairs.

Semantics: a vector links with nothing if its label or itself is null, or if
it is empty, zero, or holds a null or a value that is not finite; it keeps
its row. Vectors of different lengths do not link. Rows that repeat an id are
vectors of their own. A null id is smaller than any other where the least id
of a component is sought, and is returned as null. Empty tables give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import NULL_ID, dealt_in_tiles, salted_join, staged, whole_groups
from .components import components
from .simhash import forest

#: Vectors that the codebooks and margins are fitted on, dealt over the lengths.
#: A length takes ``LEAST_SAMPLE`` at least, and four per codeword: their number
#: grows with the root of the table.
FIT_VECTORS = 20_000
LEAST_SAMPLE = 256
#: Wanted vectors per cell, over all labels; the codebooks grow with the root of the table.
CELL_VECTORS = 64
#: Share of pairs at or above the threshold that a walk must visit.
TARGET_RECALL = 0.99
TILE = 1024


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows at length one, safe for very large and very small components."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _distances(x: np.ndarray, codewords: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * x @ codewords.T + (codewords * codewords).sum(1)[None, :]


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        at = _distances(x, centers).argmin(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, at, x)
        sizes = np.bincount(at, minlength=len(centers))
        full = sizes > 0
        centers[full] = sums[full] / sizes[full, None]
    return centers


@dataclass
class Grid:
    """Codebooks of the halves of vectors of one length, and the margin."""

    left: np.ndarray
    right: np.ndarray
    margin: float = 0.0

    def half_distances(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = x.shape[1] // 2
        return _distances(x[:, :half], self.left), _distances(x[:, half:], self.right)

    def walk(self, near: np.ndarray, far: np.ndarray) -> list[int]:
        """Cells of one vector by summed distance, the nearest first, until the margin."""
        a, b = np.argsort(near, kind="stable"), np.argsort(far, kind="stable")
        limit = near[a[0]] + far[b[0]] + self.margin
        heap, seen, cells = [(near[a[0]] + far[b[0]], 0, 0)], {(0, 0)}, []
        while heap:
            total, i, j = heapq.heappop(heap)
            if total > limit:
                break
            cells.append(int(a[i]) * len(self.right) + int(b[j]))
            for p, q in ((i + 1, j), (i, j + 1)):
                if p < len(a) and q < len(b) and (p, q) not in seen:
                    seen.add((p, q))
                    heapq.heappush(heap, (near[a[p]] + far[b[q]], p, q))
        return cells


def codewords(total: int) -> int:
    """Codewords of each half for ``total`` vectors."""
    return max(2, math.ceil(math.sqrt(total / CELL_VECTORS)))


def fit_grid(x: np.ndarray, total: int, threshold: float, seed: int = 5) -> Grid:
    """Codebooks for ``total`` vectors from the sample ``x`` of unit vectors.

    The margin covers ``TARGET_RECALL`` of pairs that lie between the
    threshold and equality: the sample's vectors turned by random angles, and
    the pairs of the sample itself. A pair is visited if either side gets to
    the other's cell.
    """
    rng = np.random.default_rng(seed)
    k = codewords(total)
    half = x.shape[1] // 2
    grid = Grid(_kmeans(x[:, :half], k, rng), _kmeans(x[:, half:], k, rng))
    if x.shape[1] < 2:
        return grid  # 1 and -1: those that link share a cell
    if len(x) < LEAST_SAMPLE:
        grid.margin = math.inf  # too few to calibrate on: all cells are visited
        return grid
    some = x[rng.choice(len(x), min(len(x), 4000), replace=False)]
    cos = rng.uniform(threshold, 1.0, len(some))[:, None]
    aside = rng.normal(size=some.shape)
    aside -= (aside * some).sum(1, keepdims=True) * some
    turned = cos * some + np.sqrt(1 - cos**2) * unit(aside)
    near = some @ some.T
    i, j = np.nonzero(np.triu(near >= threshold, 1))
    left, right = np.concatenate([some, some[i]]), np.concatenate([turned, some[j]])
    (a1, a2), (b1, b2) = grid.half_distances(left), grid.half_distances(right)
    at = np.arange(len(left))

    def beyond(p1, p2, q1, q2):
        return p1[at, q1.argmin(1)] + p2[at, q2.argmin(1)] - p1.min(1) - p2.min(1)

    needed = np.minimum(beyond(a1, a2, b1, b2), beyond(b1, b2, a1, a2))
    margins = [np.quantile(needed[: len(some)], TARGET_RECALL)]
    if len(i):
        margins.append(np.quantile(needed[len(some) :], TARGET_RECALL))
    grid.margin = float(max(margins)) + 1e-12
    return grid


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): every row with the key of its class, and one row per class."""
    value = F.col("embedding")
    good = (
        F.col("label").isNotNull()
        & value.isNotNull()
        & (F.size(value) > 0)
        & ~F.exists(value, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
        & F.exists(value, lambda v: v != 0.0)
    )
    base = vectors.select(
        F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    ).withColumn("good", F.coalesce(good, F.lit(False)))
    key_a = F.when(F.col("good"), F.xxhash64("label", "embedding")).alias("key_a")
    key_b = F.when(F.col("good"), F.xxhash64(F.lit(1), "embedding", "label")).alias("key_b")
    keyed = base.select("vec_id", "label", "embedding", "good", key_a, key_b)
    rows = staged(keyed.select("vec_id", "good", "key_a", "key_b"), "vector-rows")
    classes = (
        keyed.where("good").groupBy("key_a", "key_b")
        .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("weight"),
             F.first("label").alias("label"), F.first("embedding").alias("embedding"))
        .withColumn("size", F.size("embedding"))
        # repeated ids may give two classes one least id: number classes by key
        .withColumn("node", F.struct("low", "key_a", "key_b"))
    )
    return rows, staged(classes, "vector-classes")


_PAIR = ["label", "size", "cell", "i", "j"]


def _compare(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Per tile pair: link weights per class (``other`` null) and forest links."""
    # vectors of one length at a time
    parts = (part for whole in whole_groups(batches, _PAIR) for _, part in whole.groupby("size"))
    for part in parts:
        keys = part[_PAIR]
        new = np.concatenate([[True], (keys.to_numpy()[1:] != keys.to_numpy()[:-1]).any(1)])
        starts = np.append(np.nonzero(new)[0], len(part))
        x = unit(np.stack(part["embedding"].to_numpy()))
        home = part["home"].to_numpy()
        cell, first = part["cell"].to_numpy(), part["first"].to_numpy()
        member = home == cell
        weight = part["weight"].to_numpy()
        visits = part["visits"].to_numpy()
        number = part["number"].to_numpy()
        one_tile = (part["i"] == part["j"]).to_numpy()
        gains, a_all, b_all = np.zeros(len(part), np.int64), [], []
        for start, stop in zip(starts[:-1], starts[1:], strict=True):
            if stop - start < 2 or not member[start:stop].any():
                continue
            at = np.arange(start, stop)
            left = at if one_tile[start] else at[first[at]]
            right = at if one_tile[start] else at[~first[at]]
            near = x[left] @ x[right].T >= threshold
            a, b = np.nonzero(near)
            a, b = left[a], right[b]
            keep = (member[a] | member[b]) & ((a < b) if one_tile[start] else True)
            a, b = a[keep], b[keep]
            # a visitor and a member that visit each other meet in two cells
            mixed = np.nonzero(member[a] != member[b])[0]
            if len(mixed):
                q = np.where(member[a[mixed]], b[mixed], a[mixed])
                m = np.where(member[a[mixed]], a[mixed], b[mixed])
                mutual = np.array([home[v] in visits[w] for v, w in zip(q, m, strict=True)], bool)
                again = mixed[mutual & (number[q] > number[m])]
                a, b = np.delete(a, again), np.delete(b, again)
            np.add.at(gains, a, weight[b])
            np.add.at(gains, b, weight[a])
            a_all.append(a)
            b_all.append(b)
        counted = np.nonzero(gains)[0]
        yield pd.DataFrame({"number": number[counted], "other": pd.array([pd.NA] * len(counted), "Int64"), "gain": gains[counted]})
        if a_all:
            label = forest(len(part), np.concatenate(a_all), np.concatenate(b_all))
            moved = np.nonzero(label != np.arange(len(part)))[0]
            links = pd.DataFrame({"number": number[moved], "other": pd.array(number[label[moved]], "Int64"), "gain": 0})
            yield links[links["number"] != links["other"]]


def _shares(sizes: dict[int, int]) -> dict[int, int]:
    """How many vectors of each length the sample holds.

    Every length gets an equal share of ``FIT_VECTORS``; what a short one
    leaves goes to the others.
    """
    left, out = FIT_VECTORS, {}
    ordered = sorted((n, size) for size, n in sizes.items())
    for i, (n, size) in enumerate(ordered):
        share = max(left // (len(ordered) - i), LEAST_SAMPLE, 4 * codewords(n))
        out[size] = min(n, share)
        left = max(left - out[size], 0)
    return out


def _sample(classes: DataFrame, sizes: dict[int, int]) -> pd.DataFrame:
    """(size, embedding): of each length its share of least hash, as in ``least_by_hash``."""
    shares = [
        (size, limit, min(2**63 - 1, (2 * limit + 200) * 2**64 // max(sizes[size], 1) - 2**63))
        for size, limit in _shares(sizes).items()
    ]
    # a row per vector length
    wanted = classes.sparkSession.createDataFrame(shares, "size int, share int, line long")
    hashed = classes.select("size", "embedding", F.xxhash64("number").alias("h"))
    place = F.row_number().over(Window.partitionBy("size").orderBy("h"))
    return (
        hashed.join(F.broadcast(wanted), "size").where(F.col("h") <= F.col("line"))
        .withColumn("place", place).where(F.col("place") <= F.col("share"))
        .select("size", "embedding").toPandas()
    )


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of ``vectors``."""
    spark = vectors.sparkSession
    rows, classes = _classes(vectors)
    # a class is numbered by the hash of its key: a node id that fits a long
    classes = classes.withColumn("number", F.xxhash64("key_a", "key_b"))
    counted = classes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per vector length
    sizes = {r["size"]: r["n"] for r in counted}
    grids: dict[int, Grid] = {}
    for size, own in _sample(classes, sizes).groupby("size")["embedding"]:
        grids[int(size)] = fit_grid(unit(np.stack(own.to_numpy())), sizes[int(size)], threshold)

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for size, part in batch.groupby("size"):
                grid = grids[int(size)]
                near, far = grid.half_distances(unit(np.stack(part["embedding"].to_numpy())))
                visits = [grid.walk(a, b) for a, b in zip(near, far, strict=True)]
                yield part.assign(home=[v[0] for v in visits], visits=visits)

    fields = "number long, label string, size int, weight long, embedding array<double>"
    placed = staged(
        classes.select("number", "label", "size", "weight", "embedding").mapInPandas(
            visit, f"{fields}, home int, visits array<int>"
        ),
        "vector-cells",
    )
    lived_in = placed.groupBy("label", "size", F.col("home").alias("cell")).agg(
        F.count(F.lit(1)).alias("members")
    )
    visitors = salted_join(
        placed.withColumn("cell", F.explode("visits")),
        lived_in,
        ["label", "size", "cell"],
        ["number"],
    )
    # a cell that only its own single member visits needs no task
    found = staged(
        dealt_in_tiles(visitors.drop("members"), ["label", "size", "cell"], "number", TILE)
        .repartition(*_PAIR)
        .sortWithinPartitions(*_PAIR)
        .mapInPandas(lambda parts: _compare(parts, threshold), "number long, other long, gain long"),
        "vector-links",
    )
    gains = found.groupBy("number").agg(F.sum("gain").alias("gain"))
    roots = components(
        found.where("other is not null").select(F.col("number").alias("a"), F.col("other").alias("b"))
    )
    roots = staged(roots, "vector-components")
    known = classes.select("key_a", "key_b", "number", "low", "weight").join(
        roots, F.col("number") == F.col("node"), "left"
    )
    known = known.withColumn("root", F.coalesce("component", "number")).drop("node", "component")
    least = known.groupBy("root").agg(F.min("low").alias("least"))
    named = (
        salted_join(known, least, ["root"], ["number"])
        .join(gains, "number", "left")
        .select("key_a", "key_b", "least",
                (F.coalesce("gain", F.lit(0)) + F.col("weight") - 1).alias("links"))
    )
    good = salted_join(rows.where("good"), staged(named, "vector-names"), ["key_a", "key_b"], ["vec_id"])
    every = good.select("vec_id", "links", "least").unionByName(
        rows.where("not good").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("least"))
    )
    return every.select(
        F.when(F.col("vec_id") != NULL_ID, F.col("vec_id")).alias("vec_id"),
        F.col("links").alias("n_links"),
        F.when(F.col("least") != NULL_ID, F.col("least")).alias("component_id"),
        (F.col("vec_id") == F.col("least")).alias("kept"),
    )

"""Centroid clustering with heap-ordered bounds (Lloyd's rounds, exact).

Vectors are whole numbers, ``floor(scale * x)``. Each round gives every vector
its nearest centroid (squared Euclidean distance, ties: the smaller number) and
replaces each centroid that has vectors by the floor of their mean.

A vector's gap is its distance to the second nearest centroid less that to the
nearest. A round that moves centroids can lessen it by no more than the move of
its own centroid plus the greatest move of another; each cluster adds this up
as its drift. A cluster keeps a heap of its vectors by gap plus the drift at
the time the gap was measured, so the vectors whose gap may be used up are
those at the heap's top, below the drift of now. Only these are popped, scanned
against all centroids and pushed into their cluster's heap; all others keep
their centroid unseen.

On Spark the vectors are packed into blocks of ``BLOCK`` a row, with a heap per
cluster and block. A round maps the blocks and writes them to the shared
folder, then the round before is deleted. Blocks report sums of the vectors
that changed cluster; the driver adds clusters x components numbers, and holds
the centroids and drifts, never vectors. Distances and sums are exact integers;
bounds are doubles and count as used up ``MARGIN`` early, far beyond their
rounding, so a bound decides nothing that a scan would decide otherwise.

Semantics: kept are vectors of exactly ``dim`` components, none null or not
finite. A component beyond ``LARGEST`` after scaling has no exact squared
distance in 64 bits, and its vector is left out like one that is not finite.
The first centroids are the vectors of least sha256 of ``seed:vec_id`` (a null
id: the empty text; equal ids: the lesser vector first). Fewer vectors than
clusters give as many clusters. Repeated rows are vectors of their own. Empty
tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged_rounds

#: Vectors of a block, a row of the staged rounds.
BLOCK = 4096
#: Greatest absolute value of a scaled component: 64 squared differences fit a long.
LARGEST = 2**27
#: How far above the drift a gap already counts as used up. Bounds are below
#: 2**33, where some ten roundings of a double stay below 2e-5.
MARGIN = 1e-3

_TYPES = (np.int8, np.int16, np.int32)
_BLOCKS = "ids array<long>, width int, vectors binary"
_SEEDS = "seeds array<struct<hash: string, vector: array<int>>>"
_HEAPS = "sizes array<int>, members binary, keys binary"
_MOVED = "scanned long, moved array<struct<cluster: int, n: long, total: array<long>>>"
_RESULT = "ids array<long>, cluster array<int>, distance array<long>"


def whole_vectors(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(rows, integers) of the vectors that are kept."""
    sized = np.nonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))[0]
    flat = column.take(pa.array(sized)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(scale * values)
        good = (np.abs(scaled) <= LARGEST).all(1)  # false for NaN, nulls too
    return sized[good], scaled[good].astype(np.int64)


def _block(ids: list[int | None], vectors: np.ndarray, k: int, seed: int) -> dict:
    least = heapq.nsmallest(
        k,
        ((hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), at) for at, i in enumerate(ids)),
        key=lambda pair: (pair[0], vectors[pair[1]].tolist()),
    )
    kind = next(t for t in _TYPES if len(vectors) == 0 or np.abs(vectors).max() <= np.iinfo(t).max)
    return {
        "ids": ids,
        "width": np.dtype(kind).itemsize,
        "vectors": vectors.astype(kind).tobytes(),
        "seeds": [{"hash": h, "vector": vectors[at].tolist()} for h, at in least],
    }


def _pack(batches: Iterator[pa.RecordBatch], schema: pa.Schema, dim: int, scale: float, k: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Blocks of the vectors that are kept."""
    ids: list[int | None] = []
    vectors = np.zeros((0, dim), np.int64)
    for batch in batches:
        at, new = whole_vectors(batch.column(1), dim, scale)
        ids += batch.column(0).take(pa.array(at)).to_pylist()
        vectors = np.concatenate([vectors, new])
        while len(ids) >= BLOCK:
            yield pa.RecordBatch.from_pylist([_block(ids[:BLOCK], vectors[:BLOCK], k, seed)], schema)
            ids, vectors = ids[BLOCK:], vectors[BLOCK:]
    if ids:
        yield pa.RecordBatch.from_pylist([_block(ids, vectors, k, seed)], schema)


def distances(vectors: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Exact squared distances, a column per centroid."""
    out = np.empty((len(vectors), len(centers)), np.int64)
    for c, center in enumerate(centers):
        away = vectors - center
        out[:, c] = np.einsum("ij,ij->i", away, away)
    return out


def _heaps(row: dict, k: int) -> list[list[tuple[float, int]]]:
    """The heaps of a block, each stored in its heap order."""
    if row.get("sizes") is None:
        return [[] for _ in range(k)]
    members = np.frombuffer(row["members"], np.int32).tolist()
    keys = np.frombuffer(row["keys"], np.float64).tolist()
    out, start = [], 0
    for size in row["sizes"]:
        out.append(list(zip(keys[start : start + size], members[start : start + size], strict=True)))
        start += size
    return out


def reassign(
    vectors: np.ndarray, heaps: list[list[tuple[float, int]]], centers: np.ndarray, drift: np.ndarray, first: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bring the heaps up to date; (vectors scanned, cluster before, cluster now).

    In the first round all vectors are scanned and come from cluster -1.
    """
    if first:
        popped, before = np.arange(len(vectors)), np.full(len(vectors), -1)
    else:
        at, came = [], []
        for c, heap in enumerate(heaps):
            line = drift[c] + MARGIN
            while heap and heap[0][0] <= line:
                at.append(heapq.heappop(heap)[1])
                came.append(c)
        popped, before = np.array(at, np.int64), np.array(came, np.int64)
    found = distances(vectors[popped], centers)
    now = found.argmin(1)  # the first of equals
    if len(centers) > 1:
        two = np.sqrt(np.partition(found, 1, axis=1)[:, :2].astype(np.float64))
        keys = two[:, 1] - two[:, 0] + drift[now]
    else:
        keys = np.full(len(popped), np.inf)
    for key, i, c in zip(keys.tolist(), popped.tolist(), now.tolist(), strict=True):
        heapq.heappush(heaps[c], (key, i))
    return popped, before, now


def _changes(vectors: np.ndarray, before: np.ndarray, now: np.ndarray, k: int) -> list[dict]:
    """What the vectors that changed cluster add to each cluster's sums."""
    changed = before != now
    total, n = np.zeros((k, vectors.shape[1]), np.int64), np.zeros(k, np.int64)
    for cluster, sign in ((now, 1), (before, -1)):
        for c in np.unique(cluster[changed & (cluster >= 0)]).tolist():
            mine = changed & (cluster == c)
            total[c] += sign * vectors[mine].sum(0)
            n[c] += sign * int(mine.sum())
    some = np.nonzero((n != 0) | (total != 0).any(1))[0]
    return [{"cluster": int(c), "n": int(n[c]), "total": total[c].tolist()} for c in some]


def _vectors(row: dict, dim: int) -> np.ndarray:
    kind = next(t for t in _TYPES if np.dtype(t).itemsize == row["width"])
    return np.frombuffer(row["vectors"], kind).reshape(-1, dim).astype(np.int64)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):  # a block at a time becomes Python objects
            yield batch.slice(i, 1).to_pylist()[0]


def _round(centers: np.ndarray, drift: np.ndarray, first: bool, schema: pa.Schema):
    k, dim = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            vectors, heaps = _vectors(row, dim), _heaps(row, k)
            popped, before, now = reassign(vectors, heaps, centers, drift, first)
            flat = [entry for heap in heaps for entry in heap]
            state = {
                "sizes": [len(heap) for heap in heaps],
                "members": np.array([i for _, i in flat], np.int32).tobytes(),
                "keys": np.array([key for key, _ in flat], np.float64).tobytes(),
                "scanned": len(popped),
                "moved": _changes(vectors[popped], before, now, k),
            }
            kept = {name: row[name] for name in ("ids", "width", "vectors")}
            yield pa.RecordBatch.from_pylist([kept | state], schema)

    return run


def _last(centers: np.ndarray, drift: np.ndarray, first: bool, schema: pa.Schema):
    k, dim = centers.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            vectors, heaps = _vectors(row, dim), _heaps(row, k)
            reassign(vectors, heaps, centers, drift, first)
            cluster = np.empty(len(vectors), np.int32)
            for c, heap in enumerate(heaps):
                cluster[[i for _, i in heap]] = c
            away = vectors - centers[cluster]
            out = {"ids": row["ids"], "cluster": cluster.tolist(), "distance": np.einsum("ij,ij->i", away, away).tolist()}
            yield pa.RecordBatch.from_pylist([out], schema)

    return run


def _arrow(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl), prefers_large_types=False)


def first_centers(blocks: DataFrame, total: int, k: int) -> np.ndarray:
    """The ``k`` vectors of least hash. Each block holds its own ``k`` least.

    Only hashes below a line that somewhat more than enough ids fall under are
    sorted, so that no task or driver gathers ``k`` rows of every partition;
    the line is raised as long as repeated ids leave too few below it.
    """
    found = blocks.select(F.explode("seeds").alias("seed")).select("seed.*")
    share = (2 * k + 200) / max(total, 1)
    while True:
        line = None if share >= 1 else format(int(share * 16**15), "015x")
        below = found if line is None else found.where(F.col("hash") < line)
        # equal rows as one: however often a row is repeated, it is sorted once
        rows = below.groupBy("hash", "vector").agg(F.count(F.lit(1)).alias("n")).orderBy("hash", "vector").limit(k).collect()
        picked = [r["vector"] for r in rows for _ in range(min(r["n"], k))][:k]
        if len(picked) == min(k, total) or line is None:
            return np.array(picked, np.int64)
        share *= 16


class _Centers:
    """Centroids, their exact sums and counts, and the drifts of their clusters."""

    def __init__(self, centers: np.ndarray):
        self.at = centers
        self.drift = np.zeros(len(centers))
        self.total = [[0] * centers.shape[1] for _ in centers]
        self.n = [0] * len(centers)

    def take(self, changes: list) -> None:
        for r in changes:
            self.total[r["cluster"]][r["place"]] += int(r["total"])
            if r["place"] == 0:
                self.n[r["cluster"]] += int(r["n"])
        new = np.array(
            [[t // n for t in total] if n else old for total, n, old in zip(self.total, self.n, self.at.tolist(), strict=True)],
            np.int64,
        )
        moves = [math.sqrt(sum((int(a) - int(b)) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(new, self.at, strict=True)]
        for c in range(len(new)):
            self.drift[c] += moves[c] + max(moves[:c] + moves[c + 1 :], default=0.0)
        self.at = new


def _changes_of(blocks: DataFrame) -> list:
    """Sums over all blocks: at most clusters x components rows."""
    exact = "decimal(20,0)"
    return (
        blocks.select(F.explode("moved").alias("m"))
        .select("m.cluster", "m.n", F.posexplode("m.total").alias("place", "total"))
        .groupBy("cluster", "place")
        .agg(F.sum(F.col("n")).alias("n"), F.sum(F.col("total").cast(exact)).alias("total"))
        .collect()
    )


def cluster_vectors(
    vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: float = 64.0, seed: int = 1
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) per kept row of ``vectors``."""
    spark = vectors.sparkSession
    rounds_of = staged_rounds("cluster-round")
    packed, state = f"{_BLOCKS}, {_SEEDS}", f"{_BLOCKS}, {_HEAPS}, {_MOVED}"
    schema, state_schema, last_schema = _arrow(packed), _arrow(state), _arrow(_RESULT)
    blocks = rounds_of.keep(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(
            lambda parts: _pack(parts, schema, dim, scale, k, seed), packed
        )
    )
    total = blocks.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("n")).collect()[0]["n"]
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not total:
        return spark.createDataFrame([], names)
    centers = _Centers(first_centers(blocks, total, k))
    for i in range(rounds):
        step = _round(centers.at, centers.drift, i == 0, state_schema)
        columns = ["ids", "width", "vectors"] + ([] if i == 0 else ["sizes", "members", "keys"])
        blocks = rounds_of.keep(blocks.select(*columns).mapInArrow(step, state))
        centers.take(_changes_of(blocks))
    last = _last(centers.at, centers.drift, rounds == 0, last_schema)
    columns = ["ids", "width", "vectors"] + ([] if rounds == 0 else ["sizes", "members", "keys"])
    done = rounds_of.keep(blocks.select(*columns).mapInArrow(last, _RESULT))
    rows = done.select(F.explode(F.arrays_zip("ids", "cluster", "distance")).alias("v")).select(
        F.col("v.ids").alias("vec_id"), F.col("v.cluster").alias("cluster"), F.col("v.distance").alias("distance")
    )
    spent = {r["cluster"]: int(r["spent"]) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("spent")).collect()}
    inertia = sum(spent.values())
    named = [
        (c, spent.get(c, 0), inertia, hashlib.sha256(",".join(map(str, center)).encode()).hexdigest())
        for c, center in enumerate(centers.at.tolist())
    ]
    # one row a cluster
    known = spark.createDataFrame(named, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(known), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )

"""Centroid clustering with heap-ordered bounds against plain rounds."""

from __future__ import annotations

import hashlib
import math

import numpy as np

from sessionflow.llm import clusters, queries
from tests.compare import compare_one, duck

SF = "/root/testdata/sf0.001"
NAN, INF = float("nan"), float("inf")


def _plain(rows, k=16, rounds=3, dim=64, scale=64.0):
    kept = [
        (i, [math.floor(scale * x) for x in v])
        for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept = [(i, v) for i, v in kept if max(map(abs, v)) <= clusters.LARGEST]
    hashed = sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in kept)
    centers = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centers))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for c, members in groups.items():
            centers[c] = [sum(col) // len(members) for col in zip(*members, strict=True)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    spent = {}
    for _, c, d in found:
        spent[c] = spent.get(c, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(((i, c, d, spent[c], sum(spent.values()), digests[c]) for i, c, d in found), key=repr)


def _got(frame):
    return sorted(map(tuple, frame.collect()), key=repr)


def test_rounds_equal_plain_rounds(spark):
    """Several blocks and partitions, clear clusters, copies, repeated ids."""
    rng = np.random.default_rng(8)
    middles = rng.normal(0, 2, (20, 8))
    points = middles[rng.integers(0, 20, 1500)] + rng.normal(0, 0.3, (1500, 8))
    rows = [(i % 1400, p.tolist()) for i, p in enumerate(points)] + [(5, points[0].tolist())] * 40
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    old, clusters.BLOCK = clusters.BLOCK, 64
    try:
        for rounds in (0, 1, 3, 8):
            got = _got(clusters.cluster_vectors(frame, k=12, rounds=rounds, dim=8))
            assert got == _plain(rows, 12, rounds, 8)
    finally:
        clusters.BLOCK = old


def test_heaps_spare_scans():
    rng = np.random.default_rng(2)
    middles = rng.integers(-500, 500, (6, 4))
    x = (middles[rng.integers(0, 6, 900)] + rng.integers(-20, 20, (900, 4))).astype(np.int64)
    state, heaps, first, scanned = clusters._Centers(x[:6].copy()), [[] for _ in range(6)], True, []
    for _ in range(12):
        popped, before, now = clusters.reassign(x, heaps, state.at, state.drift, first)
        changes = clusters._changes(x[popped], before, now, 6)
        state.take([{"cluster": c["cluster"], "n": c["n"], "place": p, "total": t} for c in changes for p, t in enumerate(c["total"])])
        scanned.append(len(popped))
        for heap in heaps:
            assert all(heap[(j - 1) // 2] <= heap[j] for j in range(1, len(heap)))  # a heap
            assert len(set(heap)) == len(heap)
        first = False
    assert scanned[0] == 900 and scanned[-1] < 90


def test_each_round_equals_a_full_scan():
    rng = np.random.default_rng(4)
    x = rng.integers(-60, 60, (700, 6))
    state, heaps, first = clusters._Centers(x[:9].copy()), [[] for _ in range(9)], True
    for _ in range(10):
        centers = state.at.copy()
        popped, before, now = clusters.reassign(x, heaps, centers, state.drift, first)
        at = np.full(len(x), -1)
        for c, heap in enumerate(heaps):
            at[[i for _, i in heap]] = c
        want = clusters.distances(x, centers).argmin(1)
        assert (at == want).all()
        changes = clusters._changes(x[popped], before, now, 9)
        state.take([{"cluster": c["cluster"], "n": c["n"], "place": p, "total": t} for c in changes for p, t in enumerate(c["total"])])
        for c in range(9):
            mine = x[want == c]
            assert state.n[c] == len(mine)
            assert state.at[c].tolist() == ((mine.sum(0) // len(mine)) if len(mine) else centers[c]).tolist()
        first = False


def test_edge_vectors(spark):
    v = [0.5] * 64
    rows = [
        (1, v), (2, v), (2, v), (None, [-0.25] * 64), (3, None), (4, []), (5, [0.1] * 63), (6, [0.0] * 64),
        (7, [None] + v[1:]), (8, [NAN] + v[1:]), (9, [INF] + v[1:]), (10, [1e30] + v[1:]), (11, [-3.0e5] * 64),
    ]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    clash = frame.selectExpr("*", "'q' as cluster", "'q' as ids", "'q' as distance")
    got = _got(clusters.cluster_vectors(clash))
    assert got == _plain(rows) and len(got) == 6
    floats = frame.selectExpr("vec_id", "cast(embedding as array<float>) as embedding").where("vec_id < 10 or vec_id is null")
    assert _got(clusters.cluster_vectors(floats)) == _plain([r for r in rows if r[0] is None or r[0] < 10])
    assert clusters.cluster_vectors(frame.where("vec_id > 99")).collect() == []
    one = clusters.cluster_vectors(frame.where("vec_id = 1")).collect()
    assert [(r.cluster, r.distance, r.inertia) for r in one] == [(0, 0, 0)]


def test_query_equals_sql(spark):
    name = "op13_centroid_clustering"
    done = compare_one(spark, duck(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF)
    assert done["match"] and done["types_match"], done

"""Rendezvous sharding against a direct Python definition."""

from __future__ import annotations

import math
import struct
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from sessionflow.llm import queries, sharding

SF = "/root/testdata/sf0.001"


def _appeal(key: str, shard: int, weight: float) -> float:
    h = xxhash.xxh64_intdigest(key.encode(), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)
    h = xxhash.xxh64_intdigest(struct.pack("<i", shard), h)
    return -weight / math.log(((h >> 12) + 0.5) * 2.0**-52)


def _shard(key: str, weights) -> int:
    return max(range(len(weights)), key=lambda i: (_appeal(key, i, weights[i]), -i))


def _gapless(rows):
    seen = {}
    for r in rows:
        seen.setdefault(r.shard, []).append(r.slot)
    return all(sorted(slots) == list(range(len(slots))) for slots in seen.values())


def test_query_equals_definition(spark):
    rows = queries.queries()["op11_sharding"](spark, SF).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs) and _gapless(rows)
    for r in rows:
        data = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 1, zlib.crc32(data), "key")
        assert r.shard == _shard(str(r.doc_id), [1.0] * 16)
        assert r.grown_shard == _shard(str(r.doc_id), [1.0] * 17)
    types = dict(queries.queries()["op11_sharding"](spark, SF).dtypes)
    assert types == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string",
                     "shard": "int", "slot": "bigint", "grown_shard": "int"}


def test_shares_follow_weights_and_growth_moves_only_into_the_new_shard(spark):
    weights = [1.0, 2.0, 0.5, 4.5]
    ids = spark.range(40_000).withColumnRenamed("id", "doc_id")
    rows = sharding.with_shards(ids, "doc_id", weights, grown_by=2.0)
    n = {r.shard: r["count"] for r in rows.groupBy("shard").count().collect()}
    for i, w in enumerate(weights):
        assert abs(n[i] / 40_000 - w / 8) < 0.01
    moved = rows.where("shard <> grown_shard")
    assert [r.grown_shard for r in moved.select("grown_shard").distinct().collect()] == [4]
    assert abs(moved.count() / 40_000 - 0.2) < 0.01
    some = rows.limit(300).collect()
    assert all(r.shard == _shard(str(r.doc_id), weights) for r in some)
    # a shard taken away hands out its own records only
    fewer = sharding.with_shards(ids, "doc_id", weights[:3]).withColumnRenamed("shard", "less")
    assert rows.join(fewer, "doc_id").where("shard <> 3 and shard <> less").count() == 0


def test_slots_across_blocks(spark):
    """One key holds a third of the rows, and blocks are smaller than shards."""
    rows = spark.range(0, 3000, 1, 7).select(
        F.when(F.col("id") % 3 == 0, F.lit(None)).otherwise(F.col("id")).alias("doc_id"), F.lit("x").alias("slot")
    )
    old, sharding.BLOCK_BITS = sharding.BLOCK_BITS, 4
    try:
        out = sharding.with_slots(sharding.with_shards(rows, "doc_id", [1.0] * 5)).collect()
    finally:
        sharding.BLOCK_BITS = old
    assert len(out) == 3000 and _gapless(out)
    assert len({r.shard for r in out if r.doc_id is None}) == 1


def test_edge_rows(spark, edge_docs, no_docs):
    out = sharding.shard_documents(edge_docs, [1.0] * 16)
    rows = out.collect()
    assert len(rows) == 10 and _gapless(rows)
    by = {r.doc_id: r for r in rows if r.doc_id != 6}
    assert (by[3].size, by[3].text_crc32) == (1, 0) and by[4].size == 1
    assert by[None].shard == _shard("", [1.0] * 16)
    six = [r for r in rows if r.doc_id == 6]
    assert len(six) == 2 and six[0].shard == six[1].shard and six[0].slot != six[1].slot
    assert sharding.shard_documents(no_docs, [1.0] * 16).collect() == []
    # extra columns are carried along, clashing ones replaced
    clash = edge_docs.withColumn("shard", F.lit("q")).withColumn("slot", F.lit("q"))
    kept = sharding.with_slots(sharding.with_shards(clash, "doc_id", [1.0, 1.0]))
    assert set(kept.columns) == set(edge_docs.columns) | {"shard", "slot"} and kept.count() == 10
    with pytest.raises(ValueError):
        sharding.with_shards(edge_docs, "doc_id", [1.0, 0.0])


def test_written_shards(spark, small_docs, tmp_path):
    slotted = sharding.with_slots(sharding.with_shards(small_docs, "doc_id", [1.0] * 3))
    sharding.write_shards(slotted, str(tmp_path / "out"), file_rows=20)
    back = spark.read.parquet(str(tmp_path / "out")).withColumn("shard", F.col("shard").cast("int"))
    want = slotted.select("doc_id", "text", "shard", "slot")
    assert sorted(map(tuple, back.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
    files = back.groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.countDistinct("shard").alias("s"))
    assert all(r.s == 1 and r.n <= 20 * 8 for r in files.collect())


def test_native_plan(spark):
    plan = queries.queries()["op11_sharding"](spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan

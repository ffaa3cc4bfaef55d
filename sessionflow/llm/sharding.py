"""Weighted rendezvous hashing of records into shards (DataFrame functions only).

Every shard draws a number in (0, 1) from the hash of the record's key and the
shard's number, and the record goes to the shard of greatest
``-weight / ln(draw)`` (ties: the smaller number). A shard's share of the keys
is its weight's share of all weights. The draw of a shard does not depend on
the other shards, so one more shard takes records only into itself, and a
shard taken away hands out only its own. The law is ``key``: key, shard
numbers and weights decide, nothing else; equal texts under different keys may
come apart.

Hash and logarithm give the same result on every machine: XXH64 (seed 42) of
the key's text, then of the shard's number as a 32-bit integer, and the
strict-math logarithm of the JVM.

``with_slots`` numbers the records of each shard without gaps. Rows are written
once with a running number; blocks of at most ``BLOCK_ROWS`` consecutive rows
are numbered by themselves and moved by the counts of the blocks before them.
A block is never larger, so no key, text or shard however common fills a task.

Semantics: a null key is a key of its own, written as the empty text. Rows with
equal keys go to one shard; repeated rows keep a slot each. A null text has no
bytes. Empty tables give no rows. Columns that the functions add replace
columns of the same name; all others are carried along.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows numbered together: a power of two, as blocks are cut by a shift.
BLOCK_BITS = 16
BLOCK_ROWS = 1 << BLOCK_BITS


def _appeal(key: Column, shard: int, weight: float) -> Column:
    """How much shard ``shard`` wants the record: greater for greater weights."""
    drawn = F.xxhash64(F.xxhash64(key), F.lit(shard).cast("int"))
    # the upper 52 bits: the number stays strictly between 0 and 1
    uniform = (F.shiftrightunsigned(drawn, 12) + F.lit(0.5)) * F.lit(2.0**-52)
    return F.lit(-float(weight)) / F.log(uniform)


def _winner(key: Column, weights: Sequence[float], first: int = 0) -> Column:
    """(appeal, minus the shard's number) of the winning shard."""
    bids = [
        F.struct(_appeal(key, i, w).alias("appeal"), F.lit(-i).alias("minus"))
        for i, w in enumerate(weights, start=first)
    ]
    return F.greatest(*bids) if len(bids) > 1 else bids[0]


def key_text(key: Column) -> Column:
    return F.coalesce(key.cast("string"), F.lit(""))


def with_shards(
    rows: DataFrame, key: str, weights: Sequence[float], grown_by: float | None = None
) -> DataFrame:
    """``rows`` with ``shard``, 0 to len(weights) - 1.

    With ``grown_by`` also ``grown_shard``: the shard if one more of that
    weight were there. No shuffle: every row is judged by itself.
    """
    if not weights or min([*weights, grown_by or 1.0]) <= 0:
        raise ValueError("a shard's weight must be positive")
    text = key_text(F.col(key))
    won = rows.withColumn("_won", _winner(text, weights))
    out = won.withColumn("shard", (-F.col("_won.minus")).cast("int"))
    if grown_by is not None:
        more = len(weights)
        taken = _appeal(text, more, grown_by) > F.col("_won.appeal")
        out = out.withColumn("grown_shard", F.when(taken, F.lit(more)).otherwise(F.col("shard")).cast("int"))
    return out.drop("_won")


def with_slots(rows: DataFrame, shard: str = "shard") -> DataFrame:
    """``rows`` with ``slot``: 0, 1, ... within each shard."""
    kept = [c for c in rows.columns if c != "slot"]
    numbered = rows.select(*kept, F.monotonically_increasing_id().alias("_row"))
    # the running number has the partition in its upper bits, so a block never
    # spans two partitions; written once, it stays the same when a task is lost
    held = staged(numbered, "shard-rows").withColumn("_block", F.shiftright("_row", BLOCK_BITS))
    sizes = held.groupBy(shard, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(shard).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select(
        shard, "_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    place = F.row_number().over(Window.partitionBy(shard, "_block").orderBy("_row")) - 1
    return (
        held.withColumn("_place", place)
        .join(before, [shard, "_block"])
        .select(*kept, (F.col("_before") + F.col("_place")).cast("long").alias("slot"))
    )


def write_shards(slotted: DataFrame, path: str, file_rows: int = 1_000_000) -> None:
    """Write ``with_slots`` rows as Parquet: a folder a shard, files of ``file_rows`` slots."""
    (
        slotted.withColumn("_file", F.floor(F.col("slot") / file_rows))
        .repartition("shard", "_file")
        .sortWithinPartitions("shard", "slot")
        .drop("_file")
        .write.partitionBy("shard")
        .parquet(path)
    )


def shard_documents(docs: DataFrame, weights: Sequence[float], grown_by: float = 1.0) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of ``docs``."""
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    return with_slots(with_shards(narrow, "doc_id", weights, grown_by)).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )

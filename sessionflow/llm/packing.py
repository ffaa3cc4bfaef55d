"""Best-fit packing of tokenized documents into sequences of fixed capacity.

Planning works on counts, not documents. The histogram of piece lengths (at
most ``capacity`` numbers) is all that reaches the driver. Best-fit
decreasing runs over it: for each length, from the largest, the fullest open
sequences that still have room take as many pieces as fit, in whole intervals
of equal sequences; the rest opens new sequences. The plan is a list of slots
``(length, rank range) -> (first sequence, pieces per sequence, offset)``.
Pieces get a rank within their length (a prefix sum over salted counts plus a
row number within each salt, so no length is gathered in one task) and join
the plan on length and rank.

Semantics: a null text is empty; every row of the input, repeated or not, is
a document of its own (``ids`` then the end id). Only documents longer than
the capacity are cut. Equal lengths share slots in any order. An empty table
gives no rows. Columns other than the id and the text are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import salt, slices, staged
from .word_bpe import word_bpe

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLAN_SCHEMA = (
    "length long, rank_from long, rank_to long, sequence_from long, per_sequence long, "
    "offset_from long"
)
#: Salts that one length is spread over while it is ranked.
RANK_SALTS = 256


def tokenized_pieces(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 0,
    text: str = "text",
    id_col: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: ids then ``end_id``, cut at ``capacity``.

    Only documents longer than the capacity are cut. ``with_ids`` adds the
    column ``ids`` (array of int).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = word_bpe(tokenizer_path)
        words = codec.cache()
        for batch in batches:
            ids, done = batch.column(0), 0
            for part in slices(batch.column(1).to_pylist()):
                flat, counts = codec.encode_batch(part, words)
                row, piece, start, length, crc, kept = [], [], [], [], [], []
                ends = np.cumsum(counts).tolist()
                for i, (end, count) in enumerate(zip(ends, counts.tolist(), strict=True)):
                    whole = np.append(flat[end - count : end], end_id).astype("<u4")
                    for k, at in enumerate(range(0, count + 1, capacity)):
                        cut = whole[at : at + capacity]
                        row.append(done + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(cut))
                        crc.append(zlib.crc32(cut))
                        if with_ids:
                            kept.append(cut.astype(np.int32))
                done += len(part)
                out = [
                    ids.take(pa.array(row, pa.int64())),
                    pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()),
                    pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    schema = PIECE_SCHEMA + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, schema)


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, ...]]:
    """Best-fit decreasing over counts per length; rows of ``PLAN_SCHEMA``.

    Open sequences are kept as intervals of equal room. The work and the plan
    depend on the number of distinct lengths, not on the counts.
    """
    rooms: list[int] = []  # sorted rooms that some open sequence has
    open_by_room: dict[int, list[tuple[int, int]]] = {}  # room -> (first sequence, how many)
    plan: list[tuple[int, ...]] = []
    sequences = 0

    def put(room: int, first: int, many: int) -> None:
        if many and room:
            if room not in open_by_room:
                open_by_room[room] = []
                insort(rooms, room)
            open_by_room[room].append((first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, many = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            else:
                room, first = capacity, sequences
                many = -(-left // (capacity // length))
                sequences += many
            fit = room // length
            full, part = divmod(min(left, fit * many), fit)
            used = full * fit + part
            plan.append((length, rank, rank + used, first, fit, capacity - room))
            put(room - fit * length, first, full)
            if part:
                put(room - part * length, first + full, 1)
            put(room, first + full + (part > 0), many - full - (part > 0))
            rank, left = rank + used, left - used
    return plan


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to rows of ``PIECE_SCHEMA``.

    ``pieces`` is read three times, so pass a stored table. The driver
    collects one count per length, at most ``capacity`` rows, and the plan
    joined back is bounded by the same number, whatever the input's size.
    """
    spark = pieces.sparkSession
    keyed = pieces.withColumn(
        "_salt", salt(RANK_SALTS, "doc_id", "piece", "start", "ids_crc32")
    )
    counts = staged(keyed.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_n")), "lengths")
    histogram = {
        r["length"]: r["n"]
        for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()
    }
    plan = spark.createDataFrame(plan_slots(histogram, capacity), PLAN_SCHEMA)
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = counts.select(
        "length", "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")
    )
    within = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (
        keyed.withColumn("_row", F.row_number().over(within) - 1)
        .join(F.broadcast(bases), ["length", "_salt"])
        .withColumn("_rank", F.col("_base") + F.col("_row"))
    )
    slot = F.col("_rank") - F.col("rank_from")
    return (
        ranked.join(F.broadcast(plan.withColumnRenamed("length", "_length")),
            (F.col("length") == F.col("_length"))
            & (F.col("_rank") >= F.col("rank_from"))
            & (F.col("_rank") < F.col("rank_to")))
        .select(
            *[F.col(f"`{c}`") for c in pieces.columns],
            (F.col("sequence_from") + F.floor(slot / F.col("per_sequence"))).alias("sequence_id"),
            (F.col("offset_from") + slot % F.col("per_sequence") * F.col("length")).alias("offset"),
        )
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0
) -> DataFrame:
    """Tokenize, cut and pack whole documents: one row per piece with its place."""
    pieces = tokenized_pieces(docs, tokenizer_path, capacity, end_id)
    return pack(staged(pieces, "pieces"), capacity)

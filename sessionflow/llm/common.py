"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: Stands for a null id where ids are compared (a null id is an id of its own).
NULL_ID = -(2**63)
#: Characters handled at once inside a task; longer texts are a slice alone.
SLICE_CHARS = 2_000_000
_HASH_BASE = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _delete_folder(spark: SparkSession, path: str, at_exit: bool) -> None:
    """Delete a staged folder now, or when the session's JVM ends."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.deleteOnExit(jvm_path) if at_exit else files.delete(jvm_path, True)


def _staged_at(df: DataFrame, name: str, codec: str = "snappy") -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    _delete_folder(spark, path, at_exit=True)
    return spark.read.schema(df.schema).parquet(path), path


def staged(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once under ``spark.checkpoint.dir`` and return it read back.

    Cuts the lineage: a lost executor costs re-reading shared files. The
    folder is deleted when the session's JVM ends.
    """
    return _staged_at(df, name, codec)[0]


class staged_rounds:
    """Staged tables of an iteration, of which only the last is needed.

    ``keep`` writes a round and then deletes the round before it. What was
    read from that must be done by then.
    """

    def __init__(self, name: str):
        self.name, self.path = name, None

    def keep(self, df: DataFrame) -> DataFrame:
        out, path = _staged_at(df, self.name)
        if self.path:
            _delete_folder(df.sparkSession, self.path, at_exit=False)
        self.path = path
        return out


def salt(buckets: int, *cols: Column | str) -> Column:
    """A bucket 0..buckets-1 from the hash of ``cols``."""
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def salted_join(
    rows: DataFrame, lookup: DataFrame, keys: list[str], by: list[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join ``rows`` with ``lookup`` (one row per key) where a key may be very common.

    The rows of a key are spread over ``salts`` tasks by the hash of the
    columns ``by``; the lookup is repeated once per salt, whatever the data.
    """
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    return (
        rows.withColumn("_join_salt", salt(salts, *by))
        .join(lookup.withColumn("_join_salt", every), [*keys, "_join_salt"], how)
        .drop("_join_salt")
    )


def least_by_hash(rows: DataFrame, key: str, limit: int, *ties: str) -> DataFrame:
    """The ``limit`` rows of least ``key``, a 64-bit hash column.

    A sort with a limit keeps up to ``limit`` rows of every partition for one
    task or the driver, which grows with the table. So the rows are counted
    first, and only hashes below a line that somewhat over twice the limit
    fall under are sorted. Rows of equal hash should be made one before.
    """
    total, wanted = rows.count(), 2 * limit + 200
    if total > wanted:
        rows = rows.where(F.col(key) < wanted * 2**64 // total - 2**63)
    return rows.orderBy(key, *ties).limit(limit)


def maybe_among(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among ``ids`` (one row per id), and about one in ten of
    the others: less to shuffle for the join that follows.

    The driver gets a bit table of 8 to 16 bits per id.
    """
    bits = max(64, 1 << (8 * ids.count()).bit_length())
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    words = (
        ids.select(place.alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias("mask")).toPandas()
    )
    table = np.zeros(bits // 64, np.int64)
    table[words["at"].to_numpy(np.int64)] = words["mask"].to_numpy(np.int64)

    @F.pandas_udf("boolean")
    def among(places: pd.Series) -> pd.Series:
        p = places.to_numpy(np.int64)
        return pd.Series((table[p >> 6] >> (p & 63)) & 1 == 1, index=places.index)

    return rows.where(among(place))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id written as text leaves ``remainder``; a null id
    counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def slices(texts: Iterable[str | None], chars: int = SLICE_CHARS) -> Iterator[list[str]]:
    """Consecutive texts (null: empty) in lists of about ``chars`` characters."""
    part: list[str] = []
    size = 0
    for text in texts:
        part.append(text or "")
        size += len(part[-1]) + 1
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def word_hashes(points: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hashes of words of up to 255 code points, from where they start among ``points``."""
    order = np.argsort(length.astype(np.uint8), kind="stable")[::-1]
    at, longer = start[order], len(length) - np.cumsum(np.bincount(length, minlength=1))
    h = np.zeros(len(length), np.uint64)
    for j, n in enumerate(longer[:-1].tolist()):
        h[:n] = h[:n] * _HASH_BASE + (points[at[:n] + j] + np.uint64(1))
    out = np.empty_like(h)
    out[order] = h
    return out


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + count), one range after another."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - counts), counts)


def dealt_in_tiles(rows: DataFrame, group: list[str], by: str, tile: int) -> DataFrame:
    """Deal the rows of each group out as pairs of tiles that are compared.

    A group of more than ``tile`` rows is cut by the hash of ``by`` into tiles
    of about that size, and each row goes to every pair that its tile is in:
    columns ``i <= j`` name the pair, ``first`` whether the row is of tile i.
    Every two rows of a group meet in exactly one pair (twice the same tile
    for rows of one tile). Groups of one row are left out.
    """
    sizes = (
        rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        .select(*group, F.ceil(F.col("_n") / tile).cast("int").alias("_tiles"))
    )
    return (
        salted_join(rows, sizes, group, [by])
        .withColumn("_tile", F.pmod(F.xxhash64(by, F.lit(7)), F.col("_tiles")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
        .withColumn("i", F.least("_tile", "_other"))
        .withColumn("j", F.greatest("_tile", "_other"))
        .withColumn("first", F.col("_tile") <= F.col("_other"))
        .drop("_tile", "_other", "_tiles")
    )


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of a partition sorted by ``keys``, cut so that no group is split.

    The last group of a batch waits for the next batch; groups are tile pairs,
    so what waits is bounded.
    """
    rest = None
    for batch in batches:
        part = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if not len(part):
            continue
        named = part[keys].to_numpy()
        last = int((named == named[-1]).all(1).argmax())
        rest = part.iloc[last:]
        if last:
            yield part.iloc[:last]
    if rest is not None and len(rest):
        yield rest

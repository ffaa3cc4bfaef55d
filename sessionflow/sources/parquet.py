"""The event table stored as Parquet, partitioned by ``table_suffix``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import EVENT_SCHEMA, Period
from .base import suffix_filter


class ParquetEventSource:
    """``root/table_suffix=YYYYMMDD/*.parquet`` read with the explicit schema.

    The explicit schema keeps ``table_suffix`` a string (partition-type
    inference would make it an integer) and makes no footer scan for schema
    inference; a suffix range becomes ``PartitionFilters`` and an event-name
    list a pushed ``In`` filter.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def table(self) -> DataFrame:
        return self.spark.read.schema(EVENT_SCHEMA).parquet(self.root)

    def scan(
        self, period: Period | None = None, names: Sequence[str] | None = None
    ) -> DataFrame:
        df = self.table()
        if period is not None:
            df = df.where(suffix_filter(F.col("table_suffix"), period))
        if names is not None:
            df = df.where(F.col("event_name").isin(list(names)))
        return df


def write_events(
    df: DataFrame, root: str, files_per_day: int = 64, mode: str = "overwrite"
) -> None:
    """Store an event DataFrame in the partitioned layout.

    Rows are shuffled on (suffix, hash bucket): every day is written by
    ``files_per_day`` tasks (a day is never one task, and the file count is
    days x ``files_per_day`` instead of days x input tasks). The bucket hashes
    user *and* time, so a user holding a large share of the events is spread
    over all buckets. Within a file rows are sorted by event name, then user
    and time: row groups then hold few names, so the pushed ``event_name IN``
    filters of the funnels and purchase checks skip the row groups of other
    events on their min / max statistics. ``overwrite`` replaces the days that
    ``df`` holds and leaves the other days of the table as they are.
    """
    cols = [f.name for f in EVENT_SCHEMA.fields]
    bucket = F.pmod(F.xxhash64("user_pseudo_id", "event_timestamp"), F.lit(files_per_day))
    (
        df.select(*cols)
        .repartition("table_suffix", bucket)
        .sortWithinPartitions("table_suffix", "event_name", "user_pseudo_id", "event_timestamp")
        .write.mode(mode)
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("table_suffix")
        .parquet(root)
    )

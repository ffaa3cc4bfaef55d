"""Event sources: where the shard-range and event-name filters are applied.

Every statement starts with ``FROM events_* WHERE _TABLE_SUFFIX BETWEEN a AND b
AND event_name IN (...)``. A source turns that into the cheapest scan its
storage allows (partition pruning, Parquet pushdown) and returns the event
table in the nested layout of :data:`sessionflow.schema.EVENT_SCHEMA`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol, Union, runtime_checkable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Period


@runtime_checkable
class EventSource(Protocol):
    def scan(
        self, period: Period | None = None, names: Sequence[str] | None = None
    ) -> DataFrame:
        """Events whose suffix lies in ``period`` and whose name is in ``names``."""
        ...


def suffix_filter(col: Column, period: Period) -> Column:
    if period.start == period.end:
        return col == F.lit(period.start)
    return col.between(F.lit(period.start), F.lit(period.end))


class FrameSource:
    """Any DataFrame already in the event layout (filters as plain predicates)."""

    def __init__(self, df: DataFrame):
        self.df = df

    def scan(
        self, period: Period | None = None, names: Sequence[str] | None = None
    ) -> DataFrame:
        df = self.df
        if period is not None:
            df = df.where(suffix_filter(F.col("table_suffix"), period))
        if names is not None:
            df = df.where(F.col("event_name").isin(list(names)))
        return df


SourceLike = Union[EventSource, DataFrame]


def as_source(src: SourceLike) -> EventSource:
    if isinstance(src, DataFrame):
        return FrameSource(src)
    if isinstance(src, EventSource):
        return src
    raise TypeError(f"expected an EventSource or DataFrame, got {type(src).__name__}")

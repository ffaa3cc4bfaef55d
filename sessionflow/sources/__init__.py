"""Event sources: the stored partitioned table, any DataFrame, the test view."""

from .base import EventSource, FrameSource, as_source
from .fixture import DerivedEventSource
from .parquet import ParquetEventSource, write_events

__all__ = [
    "EventSource",
    "FrameSource",
    "as_source",
    "DerivedEventSource",
    "ParquetEventSource",
    "write_events",
]

"""sessionflow: session funnels, tracking-quality checks and commerce KPIs over a
nested, day-partitioned event log, as Spark DataFrame plans."""

from .schema import CORE_STAGES, EVENT_SCHEMA, Period
from .sources.base import FrameSource
from .sources.parquet import ParquetEventSource, write_events

__all__ = ["CORE_STAGES", "EVENT_SCHEMA", "Period", "FrameSource", "ParquetEventSource", "write_events"]
__version__ = "0.1.0"

"""Structured Streaming maintenance of the per-day result tables."""

from .daily import recompute_days, start_daily_updates

__all__ = ["recompute_days", "start_daily_updates"]

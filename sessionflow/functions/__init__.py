"""Column expressions shared by the operators."""

from .exprs import event_day, event_time, param_int, pct, ratio, safe_div, session_id, transaction_id

__all__ = ["event_day", "event_time", "param_int", "pct", "ratio", "safe_div", "session_id", "transaction_id"]

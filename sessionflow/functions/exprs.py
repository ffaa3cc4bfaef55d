"""Column expressions shared by the statements (all JVM-side, no UDF)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import NOT_SET, SESSION_PARAM


def param_int(key: str, params: str = "event_params") -> Column:
    """``(SELECT value.int_value FROM UNNEST(event_params) WHERE key = k)``.

    Position of the first matching key in ``event_params.key``, then that
    element of ``event_params.value.int_value``: row-local (no explode, no
    join, no shuffle), null when the key is absent, the first entry when
    repeated. Written with field-of-array extractions rather than a lambda
    over the structs so Parquet nested pruning reads only the ``key`` and
    ``int_value`` leaves, not the string / float / double value slots.
    """
    pos = F.array_position(F.col(f"{params}.key"), F.lit(key))  # 1-based, 0 = absent
    return F.get(F.col(f"{params}.value.int_value"), pos - 1)


def session_id() -> Column:
    return param_int(SESSION_PARAM)


def unset_to_null(c: Column) -> Column:
    """``NULLIF(c, '(not set)')``."""
    return F.nullif(c, F.lit(NOT_SET))


def transaction_id() -> Column:
    return unset_to_null(F.col("ecommerce.transaction_id"))


def event_day(text: Column | str = "event_date") -> Column:
    """``PARSE_DATE('%Y%m%d', event_date)``; raises on malformed text (ANSI).

    The parse is one-to-one and ``YYYYMMDD`` text sorts like the dates, so
    operators group, min and max on the text and parse once per result row
    instead of once per event.
    """
    return F.to_date(F.col(text) if isinstance(text, str) else text, "yyyyMMdd")


def event_time(micros: str = "event_timestamp") -> Column:
    """``TIMESTAMP_MICROS(x)`` as a UTC wall-clock ``timestamp_ntz``.

    Built by adding microseconds to the epoch, which does not depend on the
    session time zone (a ``timestamp`` -> ``timestamp_ntz`` cast would).
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.col(micros), epoch)


def safe_div(a: Column, b: Column) -> Column:
    """``SAFE_DIVIDE``: null when ``b`` is 0 or null, double result."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def pct(a: Column, b: Column) -> Column:
    """``ROUND(100 * SAFE_DIVIDE(a, b), 2)`` in this order of operations."""
    return F.round(F.lit(100) * safe_div(a, b), 2)


def pct_sql(a: str, b: str) -> str:
    """``pct`` as expression text."""
    return f"round(100 * try_divide(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 2)"


def text_sql(value: str) -> str:
    """A string literal as expression text."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def ratio(a: Column, b: Column) -> Column:
    """``ROUND(SAFE_DIVIDE(a, b), 2)``."""
    return F.round(safe_div(a, b), 2)


def event_total(amount: Column | str) -> Column:
    """Sum of a money column as a double, the same in any order of the rows.

    Doubles are summed as decimals of six places: partial sums of doubles in
    arrival order can differ in the last digit. Null where all values are null;
    values that are no finite amount count as null.
    """
    value = F.col(amount) if isinstance(amount, str) else amount
    return F.sum(value.try_cast("decimal(28,6)")).cast("double")

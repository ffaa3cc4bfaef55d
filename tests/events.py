"""Build small event tables in the nested layout from literal rows."""

from __future__ import annotations

from sessionflow.schema import EVENT_SCHEMA

DAY = "20240110"
HOUR = 3_600_000_000


def ev(
    name: str,
    t: int,
    user: str | None = "u1",
    session: int | None = 1,
    *,
    day: str = DAY,
    device: str | None = "desktop",
    country: str | None = "C",
    source: str | None = "google",
    medium: str | None = "organic",
    txn: str | None = None,
    revenue: float | None = None,
    items: int | None = 1,
    params: list[tuple[str, int]] | None = None,
) -> tuple:
    """One event row; ``t`` is in microseconds, ``session`` None = no param."""
    if params is None:
        params = [("k", 1)] + ([("ga_session_id", session)] if session is not None else [])
    return (
        day,
        t,
        name,
        user,
        [(k, (None, v, None, None)) for k, v in params],
        (device,),
        (country,),
        (source, medium),
        (txn, revenue),
        None if items is None else [(f"i{i}", None) for i in range(items)],
        day,
    )


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, EVENT_SCHEMA)

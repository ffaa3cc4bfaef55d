"""Tracking-quality checks (09.1 - 09.4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import event_day, pct, safe_div, session_id
from ..schema import CORE_STAGES, OFFICIAL_PERIOD, REVIEW_PERIOD, SESSION_PARAM, Period
from ..sources.base import SourceLike, as_source


def daily_event_counts(
    source: SourceLike, period: Period | None = REVIEW_PERIOD, names: Sequence[str] = CORE_STAGES
) -> DataFrame:
    """09.1: per day, one count column ``{name}_events`` per watched name.

    Conditional counts in one aggregate (names are fixed, so no ``pivot``
    and no extra job to discover pivot values).
    """
    ev = as_source(source).scan(period, names)
    counts = [F.count_if(F.col("event_name") == n).alias(f"{n}_events") for n in names]
    daily = ev.groupBy("event_date").agg(*counts)  # grouped on the text, parsed per day
    return daily.select(
        event_day().alias("event_date"), *[f"{n}_events" for n in names]
    ).orderBy("event_date")


def reliable_period(
    source: SourceLike,
    period: Period | None = REVIEW_PERIOD,
    watched: str = "add_to_cart",
    base: str = "view_item",
) -> DataFrame:
    """09.2: last day without any ``watched`` event, the day after it as the
    candidate start of reliable tracking, the number of such days, and the
    min / max daily ``watched`` / ``base`` percentage.

    All events of the period are counted (no name filter): a day with only
    other events is a zero day; a day without events does not exist.
    """
    ev = as_source(source).scan(period).select("event_date", "event_name")
    daily = ev.groupBy("event_date").agg(
        F.count_if(F.col("event_name") == base).alias("_base"),
        F.count_if(F.col("event_name") == watched).alias("_watched"),
    ).withColumn("_d", event_day())  # parsed once per day
    zero_day = F.when(F.col("_watched") == 0, F.col("_d"))
    ratio = safe_div(F.col("_watched"), F.col("_base"))
    return daily.agg(
        F.max(zero_day).alias("last_zero_add_to_cart_date"),
        F.date_add(F.max(zero_day), 1).alias("candidate_reliable_start_date"),
        F.count_if(F.col("_watched") == 0).alias("days_with_zero_add_to_cart"),
        F.round(F.lit(100) * F.min(ratio), 2).alias("minimum_daily_cart_to_view_pct"),
        F.round(F.lit(100) * F.max(ratio), 2).alias("maximum_daily_cart_to_view_pct"),
    )


def missing_user_id(
    source: SourceLike, period: Period | None = OFFICIAL_PERIOD, names: Sequence[str] = CORE_STAGES
) -> DataFrame:
    """09.3: core events and those without a user id."""
    ev = as_source(source).scan(period, names)
    missing = F.count_if(F.col("user_pseudo_id").isNull())
    return ev.agg(
        F.count(F.lit(1)).alias("total_core_events"),
        missing.alias("events_missing_user_id"),
        pct(missing, F.count(F.lit(1))).alias("missing_user_id_pct"),
    )


def missing_session_id(
    source: SourceLike, period: Period | None = OFFICIAL_PERIOD, names: Sequence[str] = CORE_STAGES
) -> DataFrame:
    """09.4: core events and those without a session id (nested lookup)."""
    ev = as_source(source).scan(period, names).select(session_id().alias("_s"))
    missing = F.count_if(F.col("_s").isNull())
    return ev.agg(
        F.count(F.lit(1)).alias("total_core_events"),
        missing.alias("events_missing_session_id"),
        pct(missing, F.count(F.lit(1))).alias("missing_session_id_pct"),
    )


def official_period(
    source: SourceLike,
    review: Period = REVIEW_PERIOD,
    watched: str = "add_to_cart",
    base: str = "view_item",
) -> Period | None:
    """The analysis period from 09.2's candidate reliable start date to the end
    of ``review``; ``review`` itself when no day lacks ``watched``; None when
    the last day of ``review`` lacks it (no reliable day is left).

    Brings one aggregated row to the driver; the result is a parameter for
    the other operators.
    """
    row = reliable_period(source, review, watched, base).first()
    start = row.candidate_reliable_start_date if row is not None else None
    if start is None:
        return review
    suffix = start.strftime("%Y%m%d")
    if suffix > review.end:
        return None
    return Period(max(suffix, review.start), review.end)


def repeated_param_keys(
    source: SourceLike, period: Period | None = OFFICIAL_PERIOD, key: str = SESSION_PARAM
) -> DataFrame:
    """Events whose ``event_params`` hold ``key`` more than once.

    The reference's scalar-subquery lookup fails on such rows; the lookup here
    takes the first entry, and this check counts where that choice was made.
    Reads only the ``event_params.key`` leaf.
    """
    keys = F.col("event_params.key")
    n = F.coalesce(F.array_size(F.filter(keys, lambda k: k == F.lit(key))), F.lit(0))
    ev = as_source(source).scan(period).select(n.alias("_n"))
    return ev.agg(
        F.count(F.lit(1)).alias("total_events"),
        F.count_if(F.col("_n") > 1).alias("events_with_repeated_key"),
    )

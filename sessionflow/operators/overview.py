"""Event and dataset overview (01, 02), sample records (03), one purchase
session's journey (04)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import event_day, event_time, session_id
from ..schema import JOURNEY_EVENTS, SAMPLE_DAY, Period
from ..sources.base import SourceLike, as_source

USER, SESSION = "user_pseudo_id", "ga_session_id"


def event_counts(source: SourceLike, period: Period | None = None) -> DataFrame:
    """Statement 01: events per name, largest first (ties: name)."""
    ev = as_source(source).scan(period)
    out = ev.groupBy("event_name").agg(F.count(F.lit(1)).alias("event_count"))
    return out.orderBy(F.col("event_count").desc(), "event_name")


def dataset_overview(source: SourceLike, period: Period | None = None) -> DataFrame:
    """Statement 02: first / last date, events, distinct users, distinct sessions.

    Rows are first reduced to one row per (user, session) with partial
    aggregation (a hot user or session collapses map-side); users and sessions
    are then counted on that much smaller frame. A session needs both keys
    non-null (the reference's null-propagating CONCAT).
    """
    ev = as_source(source).scan(period).select(
        F.col(USER), session_id().alias(SESSION), event_day().alias("_day")
    )
    # a date, unlike text, lives in a hash aggregate; malformed text raises on any row
    per_session = ev.groupBy(USER, SESSION).agg(
        F.min("_day").alias("_first"),
        F.max("_day").alias("_last"),
        F.count(F.lit(1)).alias("_n"),
    )
    return per_session.agg(
        F.min("_first").alias("start_date"),
        F.max("_last").alias("end_date"),
        F.coalesce(F.sum("_n").cast("long"), F.lit(0).cast("long")).alias("total_events"),
        F.count_distinct(USER).alias("total_users"),
        F.count_if(F.col(USER).isNotNull() & F.col(SESSION).isNotNull()).alias("total_sessions"),
    )


SAMPLE_COLUMNS = (
    "event_date",
    "event_time",
    "event_name",
    USER,
    SESSION,
    "device_category",
    "country",
    "traffic_source",
    "traffic_medium",
    "purchase_revenue",
    "item_count",
)


def sample_records(source: SourceLike, day: str = SAMPLE_DAY, n: int = 20) -> DataFrame:
    """Statement 03: the first ``n`` events of one day, nested fields flattened.

    Sorted by event time, then by every output column (nulls first) so ties
    give the same rows on every run. ``orderBy().limit()`` plans a
    ``TakeOrderedAndProject``: a per-partition top-n, no full sort; the date
    parse and the timestamp are computed for the n rows only.
    """
    ev = as_source(source).scan(Period.day(day))
    flat = ev.select(
        F.col("event_timestamp").alias("_ts"),
        F.col("event_date").alias("_day"),
        F.col("event_name"),
        F.col(USER),
        session_id().alias(SESSION),
        F.col("device.category").alias("device_category"),
        F.col("geo.country").alias("country"),
        F.col("traffic_source.source").alias("traffic_source"),
        F.col("traffic_source.medium").alias("traffic_medium"),
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
        F.array_size("items").alias("item_count"),
    )
    order = [F.col("_ts")] + [F.col(c).asc_nulls_first() for c in SAMPLE_COLUMNS[2:]]
    # date and time are derived after the limit: for n rows, not the whole day
    top = flat.orderBy(*order).limit(n)
    return top.select(
        event_day("_day").alias("event_date"),
        event_time("_ts").alias("event_time"),
        *SAMPLE_COLUMNS[2:],
    )


def purchase_session_journey(
    source: SourceLike, day: str = SAMPLE_DAY, event_names: Sequence[str] = JOURNEY_EVENTS
) -> DataFrame:
    """Statement 04: the busiest session of the day with a purchase, per event name:
    count, first / last time, largest revenue.

    Ties on size go to the smallest (user, session). Unlike the reference, a
    session with a null user is never chosen (its inner join would return
    nothing).

    One scan, no join: the listed names are fixed, so one per-session
    aggregate carries each name's count, first / last time and largest
    revenue next to the session's size. A global
    ``min(struct(-size, user, session, stats...))`` picks the session together
    with its statistics, and ``inline`` turns them into one row per name. Both
    aggregates are partial + final, so a huge session never gathers in a task.
    """
    names = list(event_names)
    ev = as_source(source).scan(Period.day(day)).select(
        F.col(USER),
        session_id().alias(SESSION),
        F.col("event_name"),
        F.col("event_timestamp"),
        F.col("ecommerce.purchase_revenue").alias("purchase_revenue"),
    )
    name, t, rev = F.col("event_name"), F.col("event_timestamp"), F.col("purchase_revenue")
    stats = []
    for i, nm in enumerate(names):
        hit = name == nm
        stats += [
            F.count_if(hit).alias(f"_c{i}"),
            F.min(F.when(hit, t)).alias(f"_f{i}"),
            F.max(F.when(hit, t)).alias(f"_l{i}"),
            F.max(F.when(hit, rev)).alias(f"_r{i}"),
        ]
    sessions = (
        ev.where(F.col(SESSION).isNotNull() & F.col(USER).isNotNull())
        .groupBy(USER, SESSION)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(name == "purchase").alias("_purchases"),
            *stats,
        )
        .where(F.col("_purchases") > 0)
    )
    fields = [f"_{k}{i}" for i in range(len(names)) for k in "cflr"]
    best = sessions.agg(
        F.min(F.struct((-F.col("_n")).alias("_neg_n"), USER, SESSION, *fields)).alias("_b")
    )
    rows = [
        F.struct(
            F.lit(nm).alias("event_name"),
            F.col(f"_b._c{i}").alias("event_count"),
            event_time(f"_b._f{i}").alias("first_event_time"),
            event_time(f"_b._l{i}").alias("last_event_time"),
            F.col(f"_b._r{i}").alias("purchase_revenue"),
        )
        for i, nm in enumerate(names)
    ]
    out = best.select(F.inline(F.array(*rows))).where(F.col("event_count") > 0)
    return out.orderBy("first_event_time", "event_name")

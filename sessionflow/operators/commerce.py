"""Purchase quality, revenue anomalies and e-commerce KPIs (11.1 - 11.5).

An order is (user, session, valid transaction id); its revenue is the MAX of
its events' revenues (duplicates are not summed). ``(not set)`` transaction
ids are treated as missing. Null users / sessions stay group keys of orders
but never form an order context or a session.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import (
    event_day,
    event_time,
    event_total,
    pct,
    ratio,
    session_id,
    transaction_id,
)
from ..schema import OFFICIAL_PERIOD, Period
from ..sources.base import SourceLike, as_source

USER, SESSION, TXN, REV = "user_pseudo_id", "ga_session_id", "transaction_id", "purchase_revenue"
ORDER_KEYS = (USER, SESSION, TXN)


def purchase_events(source: SourceLike, period: Period | None = OFFICIAL_PERIOD) -> DataFrame:
    """Purchase events: (date, timestamp, user, session, transaction id, revenue)."""
    ev = as_source(source).scan(period, ["purchase"])
    return ev.select(
        "event_date",
        "event_timestamp",
        F.col(USER),
        session_id().alias(SESSION),
        transaction_id().alias(TXN),
        F.col("ecommerce.purchase_revenue").alias(REV),
    )


def _order_candidates(pe: DataFrame) -> DataFrame:
    """One row per (user, session, transaction id), null ids included.

    "More than one distinct revenue" is ``min < max`` over the non-null
    values, so one partial + final aggregate suffices (no distinct level).
    """
    rev = F.col(REV)
    return pe.groupBy(*ORDER_KEYS).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(rev.isNull()).alias("_no_rev"),
        F.max(rev).alias("_paid"),
        (F.min(rev) < F.max(rev)).alias("_conflicting"),
    )


def purchase_quality(source: SourceLike, period: Period | None = OFFICIAL_PERIOD) -> DataFrame:
    """11.1: eleven counters about transaction ids and revenue in one row.

    One scan and one aggregate chain: order candidate (user, session, id) ->
    transaction id (order-level counters summed per id, plus the id's order
    contexts) -> one row. Every level is a partial +
    final aggregate, so a hot key collapses map-side; no join, no re-scan.
    """
    cand = _order_candidates(purchase_events(source, period))
    n = F.col("_n")
    rev = F.col("_paid")
    per_txn = cand.groupBy(TXN).agg(
        F.sum(n).alias("_events"),
        F.sum("_no_rev").alias("_no_rev"),
        F.count(F.lit(1)).alias("_orders"),
        F.count_if(n > 1).alias("_dup"),
        F.sum(n - 1).alias("_extra"),
        F.count_if(rev.isNull()).alias("_missing"),
        F.count_if(F.coalesce(rev, F.lit(0)) <= 0).alias("_nonpos"),
        F.count_if(F.col("_conflicting")).alias("_conflict"),
        # order contexts: distinct (user, session) pairs with both keys present;
        # the (keys, id) rows are already unique
        F.count_if(F.col(USER).isNotNull() & F.col(SESSION).isNotNull()).alias("_contexts"),
    )
    has_id = F.col(TXN).isNotNull()
    zero = F.lit(0).cast("long")

    def total(c: str, when: Column | None = has_id) -> Column:
        v = F.col(c) if when is None else F.when(when, F.col(c))
        return F.coalesce(F.sum(v).cast("long"), zero)

    return per_txn.agg(
        total("_events", None).alias("purchase_events"),
        total("_events", ~has_id).alias("events_missing_transaction_id"),
        total("_no_rev", None).alias("events_missing_revenue"),
        F.count_if(has_id).alias("unique_transaction_ids"),
        F.count_if(has_id & (F.col("_contexts") > 1)).alias("reused_transaction_ids"),
        total("_orders").alias("unique_orders"),
        total("_dup").alias("orders_with_duplicate_events"),
        # SUM over the orders: null when there is none, as in the reference
        F.sum(F.when(has_id, F.col("_extra"))).cast("long").alias("extra_duplicate_purchase_events"),
        total("_missing").alias("orders_missing_revenue"),
        total("_nonpos").alias("orders_with_non_positive_revenue"),
        total("_conflict").alias("orders_with_conflicting_revenue"),
    )


def _anomaly_filter() -> Column:
    return F.col("maximum_recorded_revenue").isNull() | (F.col("distinct_revenue_values") > 1)


def _transaction_summary(pe: DataFrame) -> DataFrame:
    """Per transaction id: events, events without revenue, the distinct
    revenue values (sorted; null when there is none), their count, min, max.

    First one row per (id, revenue), then per id: an id's events collapse
    before they meet, and only its distinct values are collected.
    """
    rev = F.col(REV)
    values = pe.where(F.col(TXN).isNotNull()).groupBy(TXN, REV).agg(F.count(F.lit(1)).alias("_n"))
    listed = F.collect_list(rev)  # distinct by the first level; nulls are left out
    return values.groupBy(TXN).agg(
        F.sum("_n").alias("purchase_events"),
        F.coalesce(F.sum(F.when(rev.isNull(), F.col("_n"))), F.lit(0)).cast("long").alias("events_missing_revenue"),
        F.count(rev).alias("distinct_revenue_values"),
        F.nullif(F.sort_array(listed), F.array().cast("array<double>")).alias(
            "recorded_revenue_values"
        ),
        F.min(rev).alias("minimum_recorded_revenue"),
        F.max(rev).alias("maximum_recorded_revenue"),
    )


#: Tasks that the events of one transaction id are spread over in 11.3.
ID_SALTS = 32


def revenue_anomalies(source: SourceLike, period: Period | None = OFFICIAL_PERIOD) -> DataFrame:
    """11.2: transaction ids with no revenue at all or more than one distinct value."""
    summary = _transaction_summary(purchase_events(source, period))
    return summary.where(_anomaly_filter()).orderBy(
        F.col("distinct_revenue_values").desc(), TXN
    )


def anomalous_purchase_events(
    source: SourceLike, period: Period | None = OFFICIAL_PERIOD
) -> DataFrame:
    """11.3: every purchase event of the anomalous transaction ids.

    The id list grows with the data, so it is a ``left_semi`` join that the
    planner sizes at run time. An id may hold a large share of the events: its
    events are spread over ``ID_SALTS`` keys and the bad ids repeated for each.
    """
    pe = purchase_events(source, period)
    # the same condition as 11.2 without its distinct level: more than one
    # distinct value <=> min < max over the non-null values
    rev = F.col(REV)
    bad = (
        pe.where(F.col(TXN).isNotNull())
        .groupBy(TXN)
        .agg(F.min(rev).alias("_lo"), F.max(rev).alias("_hi"))
        .where(F.col("_hi").isNull() | (F.col("_lo") < F.col("_hi")))
        .select(TXN)
    )
    spread = F.pmod(F.xxhash64(USER, "event_timestamp"), F.lit(ID_SALTS)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(ID_SALTS - 1)))
    hits = pe.where(F.col(TXN).isNotNull()).withColumn("_salt", spread).join(
        bad.withColumn("_salt", every), [TXN, "_salt"], "left_semi"
    )
    return hits.select(
        TXN,
        event_day().alias("event_date"),
        event_time().alias("event_time"),
        USER,
        SESSION,
        REV,
    ).orderBy(TXN, "event_time")


def _base_events(source: SourceLike, period: Period | None) -> DataFrame:
    """Events with the ``YYYYMMDD`` text of their day and the day itself."""
    ev = as_source(source).scan(period)
    return ev.select(
        F.col("event_date"),
        event_day().alias("_day"),
        F.col(USER),
        session_id().alias(SESSION),
        F.col("event_name"),
        transaction_id().alias(TXN),
        F.col("ecommerce.purchase_revenue").alias(REV),
    )


def _session_orders(base: DataFrame, *extra_keys: str) -> DataFrame:
    """One row per (extra keys, user, session) with its orders and revenue.

    First level: (extra keys, user, session, order id) where the order id is
    the valid transaction id of purchase events and null otherwise, so a
    session's non-order events fold into one row; an order's revenue is the
    MAX of its events. Second level: per session, ``count(order id)`` orders
    and the SUM of order revenues. Nulls stay group keys (as in the reference's
    GROUP BY), and the traffic counts need no second scan or join.
    """
    order_id = F.when((F.col("event_name") == "purchase") & F.col(TXN).isNotNull(), F.col(TXN))
    keyed = base.withColumn("_order", order_id)
    per_order = keyed.groupBy(*extra_keys, USER, SESSION, "_order").agg(
        F.min("_day").alias("_first"),
        F.max("_day").alias("_last"),
        F.max(F.when(F.col("_order").isNotNull(), F.col(REV))).alias("_order_revenue"),
    )
    return per_order.groupBy(*extra_keys, USER, SESSION).agg(
        F.min("_first").alias("_first"),
        F.max("_last").alias("_last"),
        F.count("_order").alias("_orders"),
        event_total("_order_revenue").alias("_revenue"),
    )


def _is_session() -> Column:
    return F.col(USER).isNotNull() & F.col(SESSION).isNotNull()


def kpi_overview(source: SourceLike, period: Period | None = OFFICIAL_PERIOD) -> DataFrame:
    """11.4: period, users, sessions, orders, revenue and the four ratios (one row).

    Revenue is null when there are no orders (so are AOV and the per-session
    and per-user values). One scan; per-order then per-session aggregates.
    """
    sessions = _session_orders(_base_events(source, period))
    kpi = sessions.agg(
        F.min("_first").alias("analysis_start_date"),
        F.max("_last").alias("analysis_end_date"),
        F.count_distinct(USER).alias("users"),
        F.count_if(_is_session()).alias("sessions"),
        F.coalesce(F.sum("_orders"), F.lit(0)).cast("long").alias("orders"),
        event_total("_revenue").alias("_revenue"),
    )
    rev = F.col("_revenue")
    return kpi.select(
        "analysis_start_date",
        "analysis_end_date",
        "users",
        "sessions",
        "orders",
        F.round(rev, 2).alias("revenue"),
        pct(F.col("orders"), F.col("sessions")).alias("purchase_conversion_rate_pct"),
        ratio(rev, F.col("orders")).alias("average_order_value"),
        ratio(rev, F.col("sessions")).alias("revenue_per_session"),
        ratio(rev, F.col("users")).alias("revenue_per_user"),
    )


def kpi_daily(source: SourceLike, period: Period | None = OFFICIAL_PERIOD) -> DataFrame:
    """11.5: the KPIs per day; days without orders show 0 orders and revenue.

    Orders are keyed by day too, so an order seen on two days counts on both
    (daily sums may exceed the overall figures, as in the reference). A day
    exists when it has events, exactly the rows of the reference's traffic
    side, so the per-day aggregate replaces its left join.
    """
    sessions = _session_orders(_base_events(source, period), "event_date")
    daily = sessions.groupBy("event_date").agg(
        F.count_distinct(USER).alias("users"),
        F.count_if(_is_session()).alias("sessions"),
        F.sum("_orders").cast("long").alias("orders"),
        event_total("_revenue").alias("_revenue"),
    )
    orders = F.col("orders")
    rev = F.coalesce(F.col("_revenue"), F.lit(0.0))
    return daily.select(
        event_day().alias("event_date"),
        "users",
        "sessions",
        "orders",
        F.round(rev, 2).alias("revenue"),
        pct(orders, F.col("sessions")).alias("purchase_conversion_rate_pct"),
        ratio(rev, orders).alias("average_order_value"),
        ratio(rev, F.col("sessions")).alias("revenue_per_session"),
    ).orderBy("event_date")

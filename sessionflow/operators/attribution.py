"""Revenue by the touch that came before the order.

A touch is the start of a session: its time, the acquisition pair of its first
event (nulls: ``(direct)`` / ``(none)``; ties: the smallest pair) and its first
non-null device. An order (user, session, valid transaction id; revenue the
MAX of its events, as in the KPIs) is linked to the latest touch of its user
that lies strictly before the order's first event; of touches at one instant
the one with the smallest session id. Orders without a user or without an
earlier touch keep their revenue under ``(no earlier touch)``, so revenue and
orders add up to the KPI overview.

Plan: every event gives a row to its session and, if it belongs to an order, a
second one to the order, so one scan and one aggregate yield touches and
orders. The as-of link has no join of orders with touches: within a user's
time block a window carries the last touch forward, and across blocks only
each block's last touch moves on. A user of any size is spread over blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import event_total, pct, ratio, session_id, transaction_id
from ..schema import DIRECT_SOURCE, NONE_MEDIUM, OFFICIAL_PERIOD, UNKNOWN_DEVICE, Period
from ..sources.base import SourceLike, as_source

USER, SESSION = "user_pseudo_id", "ga_session_id"
#: Stands in all three touch columns of orders that follow no touch.
NO_TOUCH = "(no earlier touch)"
#: Microseconds of a user's time that one task handles: an hour.
BLOCK_WIDTH = 3_600_000_000


def touches_and_orders(source: SourceLike, period: Period | None = OFFICIAL_PERIOD) -> DataFrame:
    """One row per session (``order_id`` null) and per order, in one aggregate.

    (user, session, order_id, ``t`` first time, ``touch`` of the row's events,
    ``revenue``). Rows of a session without user or session id are no touch.
    """
    order_id = F.when(F.col("event_name") == "purchase", transaction_id())
    none = F.lit(None).cast("string")
    ev = as_source(source).scan(period).select(
        USER,
        session_id().alias(SESSION),
        F.col("event_timestamp").alias("t"),
        F.struct(
            F.col("event_timestamp").alias("t"),
            F.coalesce(F.col("traffic_source.source"), F.lit(DIRECT_SOURCE)).alias("source"),
            F.coalesce(F.col("traffic_source.medium"), F.lit(NONE_MEDIUM)).alias("medium"),
        ).alias("pair"),
        F.when(
            F.col("device.category").isNotNull(),
            F.struct(F.col("event_timestamp").alias("t"), F.col("device.category").alias("device")),
        ).alias("seen"),
        F.col("ecommerce.purchase_revenue").alias("paid"),
        F.explode(F.when(order_id.isNull(), F.array(none)).otherwise(F.array(none, order_id))).alias("order_id"),
    )
    rows = ev.groupBy(USER, SESSION, "order_id").agg(
        F.min("t").alias("t"),
        F.min("pair").alias("pair"),
        F.min("seen").alias("seen"),
        F.max(F.when(F.col("order_id").isNotNull(), F.col("paid"))).alias("revenue"),
    )
    return rows.select(
        USER,
        SESSION,
        "order_id",
        "t",
        F.struct(
            F.col("pair.source").alias("source"),
            F.col("pair.medium").alias("medium"),
            F.coalesce("seen.device", F.lit(UNKNOWN_DEVICE)).alias("device"),
        ).alias("touch"),
        "revenue",
    )


def attributed_orders(
    source: SourceLike, period: Period | None = OFFICIAL_PERIOD, width: int = BLOCK_WIDTH
) -> DataFrame:
    """Every order with the touch it is linked to (null: none)."""
    rows = touches_and_orders(source, period)
    is_order = F.col("order_id").isNotNull()
    block = F.col("t") - F.pmod("t", F.lit(width))
    # orders without a user are linked to nothing: their session spreads them
    rows = rows.withColumns({"block": block, "_of": F.when(F.col(USER).isNull(), F.hash(SESSION, "order_id"))})
    usable = ~is_order & F.col(USER).isNotNull() & F.col(SESSION).isNotNull()
    given = F.when(usable, F.struct("t", (-F.col(SESSION)).alias("session"), "touch", F.lit(None).cast("double").alias("revenue")))
    # at one instant orders stand first, so a touch there is not before them;
    # the smallest session id is the last of an instant's touches
    order = [F.col("t"), (~is_order).cast("int"), F.col(SESSION).desc_nulls_first(), F.col("order_id")]
    earlier = Window.partitionBy(USER, "_of", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumn("_touch", F.last(given, ignorenulls=True).over(earlier)["touch"])
    # per block its last touch, carried on to later blocks of the user. Both
    # frames read the same columns of the same aggregate, so its exchange is
    # shared: hence no filter here, the null-safe join and the unread revenue
    last = rows.groupBy(USER, "_of", "block").agg(
        F.max(F.when(usable, F.struct("t", (-F.col(SESSION)).alias("session"), "touch", "revenue"))).alias("last")
    )
    before = Window.partitionBy(USER, "_of").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = last.select(
        F.col(USER).alias("_user"),
        F.col("_of").alias("_its"),
        F.col("block").alias("_block"),
        F.last("last", ignorenulls=True).over(before)["touch"].alias("_carried"),
    )
    same = F.col(USER).eqNullSafe(F.col("_user")) & F.col("_of").eqNullSafe(F.col("_its"))
    linked = inside.where(is_order).join(carried, same & F.col("block").eqNullSafe(F.col("_block")), "left")
    return linked.select(
        USER, SESSION, "order_id", F.col("t").alias("order_time"), "revenue",
        F.coalesce("_touch", "_carried").alias("touch"),
    )


def _labelled(field: str) -> Column:
    return F.coalesce(F.col("touch")[field], F.lit(NO_TOUCH)).alias(f"touch_{field}")


def revenue_by_touch(
    source: SourceLike, period: Period | None = OFFICIAL_PERIOD, width: int = BLOCK_WIDTH
) -> DataFrame:
    """Orders, revenue and average order value per touch channel and device.

    Revenue is null where no order of a group has any. Sums are exact (see
    ``event_total``). Largest revenue first (ties: the touch columns).
    """
    fields = ("source", "medium", "device")
    groups = attributed_orders(source, period, width).groupBy(*[_labelled(f) for f in fields]).agg(
        F.count(F.lit(1)).alias("orders"), event_total("revenue").alias("_revenue")
    )
    total = Window.partitionBy()  # a row per channel and device: a report's size
    share = pct(F.col("_revenue"), F.sum("_revenue").over(total))
    return groups.select(
        *[f"touch_{f}" for f in fields],
        "orders",
        F.round("_revenue", 2).alias("revenue"),
        share.alias("revenue_share_pct"),
        ratio(F.col("_revenue"), F.col("orders")).alias("average_order_value"),
    ).orderBy(F.desc("revenue"), *[f"touch_{f}" for f in fields])

"""Recency, frequency and monetary value per customer, scored by exact quantiles.

A customer is a user with at least one order (user, session, valid transaction
id; revenue the MAX of its events; null counts as no revenue). Recency is the
days from the last order's latest purchase day to the period's end, frequency
the number of orders, monetary their revenue. Each measure is cut into
``n`` buckets as ``NTILE(n)`` would, ties by user id; the score n is the most
recent, most frequent, most valuable. Orders without a user have no customer.
"""

from __future__ import annotations

import datetime as dt

from pyspark.ml import Pipeline
from pyspark.ml.clustering import BisectingKMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import event_day, event_total, pct, ratio
from ..plans.quantiles import bucket, quantile_cuts
from ..plans.staging import staged
from ..schema import OFFICIAL_PERIOD, Period
from ..sources.base import SourceLike
from .commerce import REV, SESSION, TXN, USER, purchase_events

#: Buckets per measure.
SCORES = 5


def _as_of(period: Period | None, as_of: dt.date | None) -> dt.date:
    if as_of is not None:
        return as_of
    if period is None:
        raise ValueError("as_of is needed without a period")
    return dt.datetime.strptime(period.end, "%Y%m%d").date()


def customer_orders(source: SourceLike, period: Period | None, as_of: dt.date) -> DataFrame:
    """(user, recency_days, frequency, monetary) per customer.

    Two partial aggregates on purchase events alone: order, then user.
    """
    pe = purchase_events(source, period).where(F.col(USER).isNotNull() & F.col(TXN).isNotNull())
    orders = pe.groupBy(USER, SESSION, TXN).agg(F.max("event_date").alias("_day"), F.max(REV).alias("_paid"))
    return orders.groupBy(USER).agg(
        F.date_diff(F.lit(as_of), event_day(F.max("_day"))).cast("long").alias("recency_days"),
        F.count(F.lit(1)).alias("frequency"),
        F.coalesce(event_total("_paid"), F.lit(0.0)).alias("monetary"),
    )


def _segment(n: int) -> Column:
    """Names for the corners of recency and frequency (own definition)."""
    r, f = F.col("recency_score"), F.col("frequency_score")
    high, low = n - 1, 2
    return (
        F.when((r >= high) & (f >= high), "champions")
        .when(f >= high, "loyal, slipping")
        .when((r >= high) & (f <= low), "new")
        .when((r <= low) & (f <= low), "lost")
        .when(r <= low, "at risk")
        .otherwise("steady")
    )


def customer_scores(
    source: SourceLike, period: Period | None = OFFICIAL_PERIOD, as_of: dt.date | None = None, n: int = SCORES
) -> DataFrame:
    """The measures, scores and segment of every customer.

    ``as_of`` is the day that recency counts to: the period's last day unless
    given. The customers are written once; each measure is sorted by itself,
    and its n - 1 cuts come back as literals, so scores need no join.
    """
    as_of = _as_of(period, as_of)
    held = staged(customer_orders(source, period, as_of), "customers")
    scores = {}
    for measure, best_is_least in (("recency_days", True), ("frequency", False), ("monetary", False)):
        order = [measure, USER]
        number = bucket(order, quantile_cuts(held, order, n))
        scores[measure.removesuffix("_days") + "_score"] = (F.lit(n + 1) - number) if best_is_least else number
    return held.withColumns(scores).withColumn("segment", _segment(n))


def segment_summary(
    source: SourceLike, period: Period | None = OFFICIAL_PERIOD, as_of: dt.date | None = None, n: int = SCORES
) -> DataFrame:
    """Per segment: customers, orders, revenue, averages, share of customers."""
    groups = customer_scores(source, period, as_of, n).groupBy("segment").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("frequency").alias("orders"),
        event_total("monetary").alias("_revenue"),
        F.sum("recency_days").alias("_days"),
    )
    every = groups.agg(F.sum("customers").alias("_all"))
    # the one row of totals joins at most six segments
    return groups.join(F.broadcast(every)).select(
        "segment",
        "customers",
        "orders",
        F.round("_revenue", 2).alias("revenue"),
        pct(F.col("customers"), F.col("_all")).alias("customers_pct"),
        ratio(F.col("_days"), F.col("customers")).alias("average_recency_days"),
        ratio(F.col("_revenue"), F.col("orders")).alias("average_order_value"),
    ).orderBy(F.desc("revenue"), "segment")


_MEASURES = ("recency_days", "frequency", "monetary")


def customer_clusters(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    as_of: dt.date | None = None,
    k: int = 4,
    seed: int = 7,
) -> DataFrame:
    """Every customer with a cluster 0..k-1 found in the three measures.

    The measures are taken as logarithms and scaled, then split in two again
    and again by Spark's bisecting k-means from a fixed seed; the rows stay on
    the executors. They are dealt by user and sorted first, as the start
    depends on their order.
    Cluster 0 has the greatest mean revenue, and so on. Fewer distinct
    customers than ``k`` give fewer clusters.
    """
    as_of = _as_of(period, as_of)
    held = staged(customer_orders(source, period, as_of), "customers")
    parts = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = held.repartition(parts, USER).sortWithinPartitions(USER)
    names = [*_MEASURES, "cluster"]
    if held.isEmpty():
        return held.withColumn("cluster", F.lit(None).cast("int")).select(USER, *names)
    # revenue may be negative: its logarithm keeps the sign
    logs = held.withColumns(
        {f"_{m}": F.signum(m) * F.log1p(F.abs(F.col(m).cast("double"))) for m in _MEASURES}
    )
    stages = [
        VectorAssembler(inputCols=[f"_{m}" for m in _MEASURES], outputCol="_raw"),
        # not centred: the first split starts beside the common centre, by a share of its length
        StandardScaler(inputCol="_raw", outputCol="_scaled"),
        BisectingKMeans(featuresCol="_scaled", predictionCol="_found", k=k, seed=seed, maxIter=40),
    ]
    found = Pipeline(stages=stages).fit(logs).transform(logs)
    means = found.groupBy("_found").agg(event_total("monetary").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    ordered = means.orderBy(F.desc(F.col("_sum") / F.col("_n")), "_found").collect()  # k rows
    number = F.create_map(*[F.lit(v) for i, r in enumerate(ordered) for v in (r["_found"], i)])
    return found.select(USER, *_MEASURES, number[F.col("_found")].alias("cluster"))


def cluster_profiles(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    as_of: dt.date | None = None,
    k: int = 4,
    seed: int = 7,
) -> DataFrame:
    """Per cluster: customers and the means of the three measures."""
    return (
        customer_clusters(source, period, as_of, k, seed)
        .groupBy("cluster")
        .agg(
            F.count(F.lit(1)).alias("customers"),
            ratio(F.sum("recency_days"), F.count(F.lit(1))).alias("average_recency_days"),
            ratio(F.sum("frequency"), F.count(F.lit(1))).alias("average_frequency"),
            ratio(event_total("monetary"), F.count(F.lit(1))).alias("average_monetary"),
        )
        .orderBy("cluster")
    )

"""Product performance: how the items of the event log are viewed, carted and bought.

The ``items`` array of an event lists products, one entry a unit. An item that
an event lists more than once counts as one event and as so many units. A
session (user and session id present) reached a stage with an item if one of
its events of that stage lists it; the order of events plays no part. Items
without id are one row, id null; a null or empty list adds nothing. The log
holds no price per item, so revenue is not split by item.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import pct, session_id
from ..schema import CORE_STAGES, OFFICIAL_PERIOD, Period
from ..sources.base import SourceLike, as_source

USER, SESSION = "user_pseudo_id", "ga_session_id"


def _listed_items() -> Column:
    """One (item_id, item_name, units) per item of an event, row by row."""

    def entry(item_id: Column) -> Column:
        same = F.filter("items", lambda it: it["item_id"].eqNullSafe(item_id))
        return F.struct(
            item_id.alias("item_id"),
            F.array_max(F.transform(same, lambda it: it["item_name"])).alias("item_name"),
            F.size(same).alias("units"),
        )

    return F.transform(F.array_distinct(F.col("items.item_id")), entry)


def item_sessions(
    source: SourceLike, period: Period | None = OFFICIAL_PERIOD, stages: Sequence[str] = CORE_STAGES
) -> DataFrame:
    """One row per (item, user, session): events per stage, units of the last stage.

    The only level that sees every listed item. It aggregates before the
    shuffle, and an item however common is spread over its sessions.
    """
    listed = as_source(source).scan(period, stages).select(
        USER, session_id().alias(SESSION), "event_name", F.explode(_listed_items()).alias("item")
    )
    name = F.col("event_name")
    return (
        listed.select(USER, SESSION, "event_name", "item.*")
        .groupBy("item_id", USER, SESSION)
        .agg(
            F.max("item_name").alias("item_name"),
            *[F.count_if(name == s).alias(f"_n{k}") for k, s in enumerate(stages)],
            F.coalesce(F.sum(F.when(name == stages[-1], F.col("units"))), F.lit(0)).alias("_units"),
        )
    )


def product_performance(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    stages: Sequence[str] = CORE_STAGES,
    top: int | None = None,
) -> DataFrame:
    """Per item: events and sessions of every stage, units bought, rates.

    A rate from stage a to stage b is the share of the item's sessions at a
    that are also at b. The most bought items come first (ties: most viewed,
    then id).
    """
    n, last = len(stages), len(stages) - 1
    is_session = F.col(USER).isNotNull() & F.col(SESSION).isNotNull()

    def sessions(*at: int) -> Column:
        held = is_session
        for k in at:
            held = held & (F.col(f"_n{k}") > 0)
        return F.count_if(held)

    per_item = item_sessions(source, period, stages).groupBy("item_id").agg(
        F.max("item_name").alias("item_name"),
        *[F.sum(f"_n{k}").alias(f"{s}_events") for k, s in enumerate(stages)],
        F.sum("_units").alias(f"{stages[last]}_units"),
        *[sessions(k).alias(f"{s}_sessions") for k, s in enumerate(stages)],
        *[sessions(k, k + 1).alias(f"_both{k}") for k in range(last)],
        sessions(0, last).alias("_ends"),
    )
    at = [F.col(f"{s}_sessions") for s in stages]
    rates = [pct(F.col(f"_both{k}"), at[k]).alias(f"{stages[k]}_to_{stages[k + 1]}_rate_pct") for k in range(last)]
    if n > 2:
        rates.append(pct(F.col("_ends"), at[0]).alias(f"{stages[0]}_to_{stages[last]}_rate_pct"))
    out = per_item.select(
        "item_id",
        "item_name",
        *[f"{s}_events" for s in stages],
        f"{stages[last]}_units",
        *[f"{s}_sessions" for s in stages],
        *rates,
    ).orderBy(F.desc(f"{stages[last]}_events"), F.desc(f"{stages[0]}_events"), "item_id")
    return out.limit(top) if top is not None else out

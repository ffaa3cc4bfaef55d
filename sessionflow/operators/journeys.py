"""Journey paths: which event follows which within a session.

The events of a session (user and session id present) are ordered by time,
events of one instant by name (their order is not known; the name makes it
definite). Every event is followed by the next one, the first by nothing: a
transition leads from ``(start)`` to the first event and from the last one to
``(exit)``. Repeated events at one instant follow each other.

Plan: equal (session, time, name) rows become one with a count before the
shuffle. Sessions are cut into time blocks; inside a block a window finds the
next event, and only the first and last event of each block meet in a window
over the session. A session of any size is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import pct, session_id
from ..schema import OFFICIAL_PERIOD, Period
from ..sources.base import SourceLike, as_source

USER, SESSION = "user_pseudo_id", "ga_session_id"
START, EXIT = "(start)", "(exit)"
#: Microseconds of a session that one task handles: an hour.
BLOCK_WIDTH = 3_600_000_000


def _steps(source: SourceLike, period: Period | None, names: Sequence[str] | None, width: int) -> DataFrame:
    """(user, session, block, t, name, n), with the next step inside the block."""
    steps = (
        as_source(source).scan(period, names)
        .select(USER, session_id().alias(SESSION), F.col("event_timestamp").alias("t"), F.col("event_name").alias("name"))
        .where(F.col(USER).isNotNull() & F.col(SESSION).isNotNull() & F.col("name").isNotNull())
        .groupBy(USER, SESSION, "t", "name")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("block", F.col("t") - F.pmod("t", F.lit(width)))
    )
    inside = Window.partitionBy(USER, SESSION, "block").orderBy("t", "name")
    return steps.withColumns(
        {"following": F.lead("name").over(inside), "place": F.row_number().over(inside)}
    )


def journey_transitions(
    source: SourceLike,
    period: Period | None = OFFICIAL_PERIOD,
    names: Sequence[str] | None = None,
    width: int = BLOCK_WIDTH,
) -> DataFrame:
    """Transitions between events of a session, with their share of the ``from_event``.

    ``names`` keeps only these events (others are passed over). Largest
    ``from_event`` groups are not special: counts are partial aggregates.
    """
    steps = _steps(source, period, names, width)
    # both frames read the same columns of the window's input, whose exchange they share
    within = steps.select(
        F.explode(
            F.array(
                F.struct(F.col("name").alias("a"), F.col("name").alias("b"), (F.col("n") - 1).alias("n")),
                F.struct(F.col("name").alias("a"), F.col("following").alias("b"), F.lit(1).cast("long").alias("n")),
            )
        ).alias("step")
    ).select("step.*").where(F.col("b").isNotNull() & (F.col("n") > 0))
    ends = (
        steps.where((F.col("place") == 1) | F.col("following").isNull())
        .groupBy(USER, SESSION, "block")
        .agg(
            F.min(F.struct("t", "name", "n")).alias("first"),
            F.max(F.struct("t", "name", "n")).alias("last"),
        )
    )
    of_session = Window.partitionBy(USER, SESSION).orderBy("block")
    after = F.coalesce(F.lead("first").over(of_session)["name"], F.lit(EXIT))
    across = ends.select(
        F.col("first.name").alias("first"),
        F.col("last.name").alias("last"),
        F.lag("block").over(of_session).isNull().alias("begins"),
        after.alias("after"),
    ).select(
        F.explode(
            F.array(
                F.struct(F.col("last").alias("a"), F.col("after").alias("b")),
                F.when(F.col("begins"), F.struct(F.lit(START).alias("a"), F.col("first").alias("b"))),
            )
        ).alias("step")
    ).where("step is not null").select("step.a", "step.b", F.lit(1).cast("long").alias("n"))
    counts = within.unionByName(across).groupBy("a", "b").agg(F.sum("n").alias("transitions"))
    total = Window.partitionBy("a")  # a row per pair of event names
    return counts.select(
        F.col("a").alias("from_event"),
        F.col("b").alias("to_event"),
        "transitions",
        pct(F.col("transitions"), F.sum("transitions").over(total)).alias("share_of_from_pct"),
    ).orderBy("from_event", F.desc("transitions"), "to_event")

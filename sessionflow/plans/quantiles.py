"""Exact quantile cuts and ``ntile`` buckets of a distributed frame.

``NTILE(n) OVER (ORDER BY ...)`` is one task in Spark: a window without a
partition gathers all rows. Here the rows are sorted over all tasks (a range
exchange), written once with their place (partition and running number), and
counted per partition. The counts tell at which place of which partition a
bucket ends, so n - 1 rows are read back: the cuts. A row's bucket is the
number of cuts below it; nothing is joined and no rank is computed per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from .staging import staged

#: ``monotonically_increasing_id`` has the partition above these bits.
_PLACE_BITS = 33


def bucket_ends(total: int, n: int) -> list[int]:
    """Ranks (from 0) of the last row of every bucket but the last.

    As ``ntile``: buckets differ by one row at most, the larger ones come
    first; with fewer rows than buckets, the last buckets stay empty.
    """
    size, larger = divmod(total, n)
    ends = [size * (i + 1) + min(i + 1, larger) - 1 for i in range(n - 1)]
    return [e for e in ends if 0 <= e < total - 1]


def quantile_cuts(df: DataFrame, order: Sequence[str], n: int) -> list[Row]:
    """The last row (``order`` columns, ascending) of each ``ntile`` bucket but the last.

    ``order`` must make rows distinct. Brings one count per partition and
    n - 1 rows to the driver.
    """
    ordered = df.select(*order).orderBy(*order).withColumn("_place", F.monotonically_increasing_id())
    held = staged(ordered, "ordered")
    part = F.shiftright("_place", _PLACE_BITS)
    counts = held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    total = sum(r["n"] for r in counts)
    ends, places, before = bucket_ends(total, n), [], 0
    for r in counts:
        places += [(r["part"] << _PLACE_BITS) + e - before for e in ends if before <= e < before + r["n"]]
        before += r["n"]
    if not places:
        return []
    # a point filter: row groups without the places are skipped
    return held.where(F.col("_place").isin(places)).orderBy("_place").drop("_place").collect()


def bucket(order: Sequence[str], cuts: Sequence[Row]) -> Column:
    """The bucket 1..n of a row: one more than the cuts below it.

    Compares (order columns) with every cut column by column, nulls first, as
    an ascending sort does.
    """
    number = F.lit(1)
    for cut in cuts:
        above, equal = F.lit(False), F.lit(True)
        for name in order:
            value, at = F.col(name), F.lit(cut[name])
            greater = value.isNotNull() if cut[name] is None else F.coalesce(value > at, F.lit(False))
            above = above | (equal & greater)
            equal = equal & value.eqNullSafe(at)
        number = number + above.cast("int")
    return number

"""Connected components of a link table, by alternating stars.

Each round applies the two star operations (every node links its larger, then
its smaller neighbours to the least of them) until the links stop changing:
then every node links directly to the least node of its component. Minima are
aggregated before they are joined back, and the join is salted, so a node
with very many neighbours is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import salted_join, staged


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (
        salted_join(both, least, ["u"], ["v"])
        .where("v > u")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .where("u <> v")
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` run from the larger node u to the smaller node v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = salted_join(links, least, ["u"], ["v"]).where("v <> m").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b: orderable ids).

    ``component`` is the least node reachable. Links may repeat, run either
    way or from a node to itself; nodes without links to others are absent.
    Every round is written to the checkpoint folder.
    """
    links = staged(
        links.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )

    def sign(df: DataFrame):
        return df.agg(
            F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.crc32(F.concat_ws(",", "u", "v")))
        ).first()

    before = sign(links)
    while before[0]:
        links = staged(_small_star(_large_star(links)), "links")
        after = sign(links)
        if after == before:
            break
        before = after
    nodes = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)

"""Connected components of a link table, by alternating large and small stars; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equipoise.sources.session import checkpoint


def _star(links: DataFrame) -> DataFrame:
    """(u, v, m): each link with the smallest of u and its neighbours. The minimum is combined before the shuffle."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    return links.join(least, "u").select("u", "v", F.least("u", "m").alias("m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (u, v): root is the smallest node that can be reached.

    Rounds go on until the table stays the same, logarithmically many in the length of the longest path; each is
    checkpointed, so that a lost executor costs one round at most. Repeated links and links of a node to itself are
    allowed; nodes without links are not listed.
    """
    links = checkpoint(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _star(large).select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        links = checkpoint(small.where("u <> v").distinct())
        state = links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
            )
        seen = state

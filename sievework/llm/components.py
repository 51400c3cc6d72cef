"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum and a join; nothing is collected but one checksum row per round, and
each round is written to the shared folder, which cuts the lineage. The number of rounds grows with the
logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.session import materialize


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Point neighbours at the least neighbour: those above the node (large) or the others (small)."""
    if large:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:  # from the greater end down
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = both.join(least, "a")
    if large:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        own = least.select("a", F.col("m").alias("b"))
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(own)
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of a link (a, b) that is not the least of its component."""
    current = materialize(links.select("a", "b").where("a <> b"), "links")
    seen = None
    while True:
        now = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        current = materialize(_star(_star(current, large=True), large=False), "links")

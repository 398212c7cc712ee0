"""Connected components of links in a DataFrame, by alternating large-star and small-star steps.

Every step is a grouped minimum and a join on the node; the minimum has one row per node, so a hub's links can be split by
the adaptive skew join.  After each pair of steps the links are stored in the shared folder, and the loop ends when a pair
of steps changes nothing.  Nothing but a count and a checksum comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._frames import discard, stored


def _least(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every greater neighbour of a node goes to the least of the node and its neighbours."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every lesser neighbour of a node, and the node, goes to the least of them; links point from greater to lesser."""
    met = links.join(_least(links), "u")
    moved = met.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v")
    return moved.unionByName(met.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link in (a, b); root is the least node of the component.

    Null ends and links of a node with itself are left out.
    """
    ends = links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    state = stored(ends, "links")
    mark = None
    while True:
        now = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
        after = stored(_small_star(_large_star(state)), "links")
        discard(state)
        state = after
    roots = state.select(F.col("v").alias("node")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))

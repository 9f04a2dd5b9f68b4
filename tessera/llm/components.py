"""Connected components of a graph of links, by alternating large-star and small-star steps on DataFrames.

A step hangs the neighbours of each node on the smallest one: the large star those that are larger than the node, the small
star the node itself and those that are smaller. Both keep the components, and the links of a node are only ever grouped
under their minimum, which aggregates before it shuffles, so a node with very many links is no hot spot for it; the number
of rounds grows with the logarithm of a component's size. Every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def settled(now: DataFrame) -> bool:
    """Whether links that all go down are stars: no node hangs on two others, or on one that hangs itself."""
    ends = now.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(now.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return nodes.agg(F.count_if((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).alias("n")).first().n == 0


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (its smallest node) of every node that has a link. links: a, b, any order, repeats allowed."""
    now = common.stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        if settled(now):
            break
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")  # repeats go below
        # every link now goes down from its larger end
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(smallest, "a").select(F.explode(F.array(F.struct(F.col("a").alias("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("l")).select("l.*").filter("a <> b").distinct()
        now = common.stored(small, "links")
    else:
        raise RuntimeError(f"components are not settled after {most_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)

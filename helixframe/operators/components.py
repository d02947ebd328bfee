"""Connected components of links between nodes, by contraction in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.deploy import written


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of links ``a, b`` (of one type that can be ordered): the least node that each is connected with.

    In turn, the neighbours above a node are linked to its least neighbour, and then the ones
    below it, until every node hangs on its root. Rounds grow with the logarithm of the longest path.
    Each round is written to the shared folder, and what hangs on one node is joined, never listed.
    Links of a node with itself give it no row.
    """
    low = F.when(F.col("a") < F.col("b"), F.col("a")).otherwise(F.col("b"))
    high = F.when(F.col("a") < F.col("b"), F.col("b")).otherwise(F.col("a"))
    edges = written(links.filter("a != b").select(high.alias("u"), low.alias("v")).distinct(), "links")
    known = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.when(F.col("_m") < F.col("u"), F.col("_m")).otherwise(F.col("u")).alias("m"))
        above = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = above.groupBy("u").agg(F.min("v").alias("m"))
        below = above.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(below.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        state = tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == known or not state[0]:
            break
        known = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()

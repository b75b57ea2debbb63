"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, stored


def components(edges: DataFrame) -> DataFrame:
    """node, label for every node of the edges (a, b); label is the smallest node of the component.

    Each step is a grouping with partial aggregation and a join on the node. Both are stored in the shared folder: lineage
    stays short, and a join has two plain shuffles, so that Spark can split a hub's edges over tasks. The number of steps grows with the logarithm of the longest chain. Loops (a = b) are allowed.
    """
    now = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a != b")
    last = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stored(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "down")
        parent = stored(down.groupBy("a").agg(F.min("b").alias("m")), "parents")
        small = down.join(parent, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        small = stored(small, "stars")
        dropped(least, down, parent, *([last] if last else []))
        # done when every node has one parent and no parent has one
        again = small.groupBy("a").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count() or small.select("a").join(small.select(F.col("b").alias("a")), "a", "left_semi").limit(1).count()
        now = last = small
        if not again:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())

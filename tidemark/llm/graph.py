"""Connected components by alternating large and small stars, with a written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written


def components(links: DataFrame) -> DataFrame:
    """links: a, b (longs; any direction, repeats allowed).  Returns node, root: the smallest node reachable, for nodes in links.

    A hub's neighbours meet in an aggregate with partial sums and in a join that can be split, never in one task.  Every edge
    leads to a smaller node, so the rounds end exactly when no node has two edges, or one and is led to as well.
    """
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("from"), F.lit(0).alias("to")).union(edges.select("b", F.lit(0), F.lit(1)))
        if ends.groupBy("v").agg(F.sum("from").alias("f"), F.max("to").alias("t")).filter("f > 1 or f = 1 and t = 1").isEmpty():
            found = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            found = written(found.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "found")
            drop(edges)
            return found
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("m", "a").alias("m")), "low")
        large = both.join(low, F.col("a") == F.col("u")).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = written(large.union(low.filter("u <> m").select("u", "m")).filter("a <> b").distinct(), "large")
        least = written(large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u"), "least")
        small = large.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, written(small.union(least.select("u", "m")).filter("a <> b").distinct(), "edges")
        drop(before, low, large, least)

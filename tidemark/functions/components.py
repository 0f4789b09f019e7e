"""Connected components of a table of edges, in a number of rounds that grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.lineage import discard, settle


def components(edges: DataFrame) -> DataFrame:
    """id, root (the smallest id of its component) of every end of an edge (a, b). Edges have no direction; an edge from an id to itself names it alone.

    Every id points to a smaller one of its component, at first to its least neighbour. In a round it learns its
    neighbours' grandparents, takes the least of these for itself and for the id it points to, and skips to its own
    grandparent (stochastic hooking and shortcutting, as in the FastSV algorithm). Nothing changes any more when all ends of edges
    point to the same id.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    last = settle(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("root")), "roots")
    while True:
        roots = last.select("id", "root")
        upper = roots.select(F.col("id").alias("root"), F.col("root").alias("grand"))
        known = roots.join(upper, "root").select("id", "root", "grand")
        least = both.join(known.select(F.col("id").alias("b"), "grand"), "b").groupBy(F.col("a").alias("id")).agg(F.min("grand").alias("near"))
        told = known.join(least, "id")
        own = told.select("id", F.least("near", "grand").alias("root"), F.col("root").alias("before"))
        hooked = told.select(F.col("root").alias("id"), F.col("near").alias("root"), F.lit(None).cast(own.schema["before"].dataType).alias("before"))
        new = settle(own.unionByName(hooked).groupBy("id").agg(F.min("root").alias("root"), F.max("before").alias("before")), "roots")
        discard(last)
        last = new
        if new.filter("root <> before").isEmpty():
            return new.select("id", "root")

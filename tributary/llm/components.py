"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tributary.llm.common import drop_scratch, scratch_paths, stored


def components(edges: DataFrame) -> DataFrame:
    """edges a, b (long) -> id, root: the smallest id reachable, for every id that has an edge.

    Every round is two shuffles of at most as many rows as there are edges; the
    edges of an id are never gathered, only their minimum is. Rounds grow with
    the logarithm of the ids. Only a count of changes comes to the driver. The
    minima are stored before they are joined, so that both sides of a join are
    plain shuffles and a hub's edges can be split; a round's tables go once the
    next is stored.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    kept = set(scratch_paths())
    edges = stored(edges, "edges")
    while True:
        before = set(scratch_paths()) - kept
        # Large star: each id's larger neighbours point at the smallest id next to it.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = stored(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        # Small star: each id's smaller neighbours, and itself, point at the smallest of them.
        small = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = large.join(small, "a")
        new = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        between = set(scratch_paths()) - kept - before
        new = stored(new, "edges")
        drop_scratch([*before, *between])
        # A star forest maps to itself: nobody is both a root and a leaf, and every leaf has one root.
        n, leaves = new.agg(F.count(F.lit(1)), F.countDistinct("a")).first()
        if n == leaves and not new.join(new.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count():
            return new.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(new.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        edges = new

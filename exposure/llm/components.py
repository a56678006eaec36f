"""Connected components of a graph given as edges, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from exposure.llm.shared import stored


def _stars(edges: DataFrame) -> bool:
    """Whether every node hangs on one smaller node that hangs on none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    per_node = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not per_node.where("up > 1 or (up = 1 and down = 1)").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the smallest node it is connected with.

    Each round hangs a node's larger neighbours, then all its neighbours that are no larger, on its smallest neighbour
    (large-star and small-star). A node of many neighbours is summed up before the shuffle, and the join that returns its
    minimum is one that adaptive execution can split. Rounds are stored, and end when all
    edges are stars. Edges with a null end and loops tell nothing and are left out.
    """
    now = stored(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = stored(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        now = stored(small.where("a <> b").distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())

"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import staged


def _stars(edges: DataFrame) -> bool:
    """Whether each node hangs from one node that hangs from none: then the edges are the components."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.max("up").alias("up"), F.sum("down").alias("down"))
    return seen.agg(F.count_if((F.col("down") > 1) | ((F.col("up") == 1) & (F.col("down") > 0)))).first()[0] == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Edges (a, b) of longs -> (node, class), class being the least node reached.

    Alternates the large-star and small-star steps: each node's larger
    neighbours, then its smaller ones, are linked to the least of them. Each
    step is a grouped minimum (combined before the shuffle) and an inner join,
    so a hub's edges may be split over tasks. Self loops and repeated rows do
    no harm; an edge with a null end is ignored; no edges give no rows.
    Rounds needed grow with the logarithm of the longest chain.
    """
    at = staged(
        edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )
    for _ in range(max_rounds):
        if _stars(at):
            break
        both = at.select("a", "b").unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = (
            both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()
        )
        # small star: b's smaller neighbours (here the a of each edge) meet at their least
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
        at = staged(small.where("a <> b").distinct())
    else:
        raise RuntimeError("components did not settle")
    ends = at.select(F.col("b").alias("node"), F.col("a").alias("class"))
    roots = at.select(F.col("a").alias("node"), F.col("a").alias("class")).distinct()
    return ends.unionByName(roots)

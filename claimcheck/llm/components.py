"""Connected components of a graph given as edges, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from claimcheck.llm.shared import written


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """pairs: (u, v), v a neighbour of u. Links the neighbours on one side of u to the least of u and them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(least, "u")
    if larger:
        return joined.where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.where("u > m").select("u", F.col("m").alias("v"))
    return joined.where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(own)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the least node it can reach.

    edges: (a, b), long, either direction, repeats allowed. Each round is written to the
    shared folder. Rounds grow with the logarithm of the number of nodes; a hub's edges are
    pre-aggregated before they are shuffled, and its joins can be split.
    """
    star = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    while True:
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(_star(both, True).distinct(), "large-star")
        star = written(_star(large, False).distinct(), "small-star")
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)

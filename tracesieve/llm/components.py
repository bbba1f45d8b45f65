"""Connected components of a distributed edge list by alternating star contractions.

Every round replaces the neighbours of a node by links to the smallest one among them, first for
the larger neighbours and then for the smaller ones. Minima combine before the shuffle, so a node
with very many links costs no single task more than its share; adaptive execution splits the join
that follows. The number of rounds grows with the logarithm of the diameter. Two numbers a round
reach the driver, never links or labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracesieve.llm.common import stored


def connected_components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node that has a link to another one; component is the smallest
    node reachable. Nulls and links of a node with itself are ignored, repeated links count once;
    no edges give no rows."""
    links = stored(
        edges.select(F.greatest(u, v).alias("a"), F.least(u, v).alias("b"))
        .where(F.col("a") != F.col("b"))
        .distinct()
    )
    seen = _digest(links)
    while seen[0]:
        links = stored(_small_star(_large_star(links)))
        now = _digest(links)
        if now == seen:
            break
        seen = now
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return members.unionByName(roots)


def _digest(links: DataFrame) -> tuple:
    hashed = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(links.agg(F.count("*"), F.sum(hashed)).first())


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("n"), F.col("b").alias("m")).unionByName(
        links.select(F.col("b").alias("n"), F.col("a").alias("m"))
    )
    low = both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("r"))
    # Only larger neighbours move: every such pair is a link seen from its smaller end.
    larger = links.select(F.col("b").alias("n"), F.col("a").alias("m"))
    return (
        larger.join(low, "n")
        .where(F.col("m") != F.col("r"))
        .select(F.col("m").alias("a"), F.col("r").alias("b"))
        .distinct()
    )


def _small_star(links: DataFrame) -> DataFrame:
    low = links.groupBy("a").agg(F.min("b").alias("r"))
    moved = links.join(low, "a").where(F.col("b") != F.col("r"))
    return (
        moved.select(F.col("b").alias("a"), F.col("r").alias("b"))
        .unionByName(low.select("a", F.col("r").alias("b")))
        .distinct()
    )

"""Connected components of a large graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: each node's larger (or not larger) neighbours are tied to the least node that it sees."""
    if large:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u")
    if large:
        tied = tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(least.select("u", F.col("m").alias("v")))
    return tied.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, component) for every node of the edges (u, v); the component is the least node that can be reached.

    Rounds grow with the logarithm of the longest path. Each round is cut off by a checkpoint, so a lost executor costs
    a round at most. A hot centre is one row in each sum and a skewed key in each join, which Spark splits.
    """
    edges = durable(edges.select("u", "v").filter(F.col("u") != F.col("v")).distinct())
    before = None
    for _ in range(rounds):
        edges = durable(_star(_star(edges, True), False))
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots)

"""Connected components of an edge table, in Spark throughout.

Alternating large and small stars (Kiveris et al., "Connected Components in
MapReduce and Beyond", 2014): every step re-hangs neighbours on the smallest
neighbour with one aggregation and one join, so no node's neighbourhood is
ever collected; it ends after O(log^2 n) rounds in the worst case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopstat.llm.common import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # written, so that the join's sides come straight from a shuffle and a node with very many neighbours can be split
    least = materialise(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    return (both.filter(F.col("v") > F.col("u")).join(least, "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` has u > v, as the large star leaves it."""
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
    hung = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node that has an edge; the root is the
    component's smallest node.  ``edges``: columns u, v; loops, both
    directions and repeated edges are allowed, null ends are not edges."""
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(
        edges["u"].isNotNull() & edges["v"].isNotNull() & (F.col("u") != F.col("v"))).distinct()
    e = materialise(e, "cc-edges")
    before = _state(e)
    while before[0]:
        e = materialise(_small_star(materialise(_large_star(e), "cc-star")), "cc-edges")
        now = _state(e)
        if now == before:
            break
        before = now
    # stars at the end: every node hangs on its root; the root itself is added
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())

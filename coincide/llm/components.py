"""Connected components of an edge table by alternating large and small stars.

Every round is a few joins and aggregations over the edges, written to the shared folder, so lost
executors cost no more than their share of a round. The number of rounds grows with the logarithm of
the longest chain; each round at least halves distances to the smallest node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coincide.llm.stage import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b), the root being its component's least node."""
    edge = written(_pairs(edges.where("a <> b")), "edges")
    state = None
    while True:
        edge = written(_small(_large(edge)), "edges")
        seen = edge.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()  # the same in any order
        if tuple(seen) == state or not seen[0]:
            break
        state = tuple(seen)
    return edge.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(edge.select("b", "b").distinct())


def _pairs(edges: DataFrame) -> DataFrame:
    """Each edge once, from the larger to the smaller node."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large(edge: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the node's least neighbour."""
    both = edge.unionAll(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()


def _small(edge: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the least of them."""
    least = edge.groupBy("a").agg(F.min("b").alias("m"))
    other = edge.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return _pairs(least.select("a", F.col("m").alias("b")).unionAll(other))

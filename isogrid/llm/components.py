"""Connected components of a graph given by its edges, without gathering edges or nodes anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._util import materialize


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the component's least node), for all nodes of edges (a, b).

    Alternating large-star and small-star steps; each keeps one row an edge and a minimum by node, so a node with very many
    neighbours costs no list. Every round is written to the shared folder; rounds grow with the logarithm of the nodes.
    """
    edges = edges.filter("a <> b")
    edges = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    mark = _mark(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: neighbours above a node go to the least of its surroundings
        large = both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").filter("a <> b").distinct()
        # small star: neighbours below a node, and the node itself, go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select("m", F.explode(F.array("a", "b")).alias("x")).filter("m <> x")
        edges = materialize(small.select(F.col("m").alias("a"), F.col("x").alias("b")).distinct(), name)
        now = _mark(edges)
        if now == mark:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        mark = now


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges: their number and two sums of hashes."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.sum(F.hash("b", "a").cast("long"))).first())

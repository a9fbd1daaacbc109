"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorehouse.session import cut_lineage


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour (or itself)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "least").alias("least"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """The smaller neighbours of a node, and the node, are tied to the least of them."""
    turned = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = _least(turned)
    tied = turned.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return tied.union(least.select("u", F.col("least").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) of every node that has an edge.

    Edges are columns ``u`` and ``v`` of one orderable type. Loops over steps
    that each shuffle the edges a few times; nothing but two sums reaches the
    driver. Ends when a step changes no edge.
    """

    def state(frame: DataFrame) -> tuple:
        hashed = F.xxhash64("u", "v")
        return tuple(frame.agg(F.count(F.lit(1)), F.sum(F.shiftright(hashed, 24)), F.bit_xor(hashed)).first())

    now = cut_lineage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    known = state(now)
    while known[0]:
        now = cut_lineage(_small_star(_large_star(now)), "edges")
        found = state(now)
        if found == known:
            break
        known = found
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(now.select("v", "v").distinct())

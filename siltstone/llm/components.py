"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.shared import dispose, written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each neighbour of a node to the least of the node and its neighbours: the larger ones, or the others."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    both = both.union(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b long): the component is its least node.

    Each round halves the depth of the trees at least, so the rounds grow with the logarithm of the longest path.  Rounds
    are written tables in the shared folder: nothing is collected but a sum that shows when the edges stay the same.  As
    edges only ever move to lesser nodes, that comes to pass for every graph.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    print_of = lambda df: tuple(df.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    now = written(now, "edges")
    before = print_of(now)
    while True:
        last, now = now, written(_star(_star(now, True), False), "edges")
        dispose(last)
        after = print_of(now)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
        before = after

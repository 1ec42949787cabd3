"""Connected components of a table of links, by alternating star contractions; no part of the graph leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def stars(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the least node reachable) for every node of `links` (a long, b long; either order, repeats and
    loops allowed) but the least of each component. Each round is two grouped minima; a hot node's links are
    pre-aggregated for its minimum and its join is split by adaptive execution."""
    edges = materialize(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    for _ in range(most_rounds):
        # settled: every node has one link, to a least node, which has none to a smaller one
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("down")))).alias("e"))
        ends = ends.groupBy("e.node").agg(F.sum("e.down").alias("down"), F.min("e.down").alias("least"))
        if ends.where("down > 1 or down = 1 and least = 0").isEmpty():
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        # large star: a node's larger neighbours go to the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star")
        # small star: a node and its smaller neighbours go to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        edges = materialize(small.where("a <> b").distinct(), "small-star")
    raise RuntimeError("components did not settle")


def components(links: DataFrame) -> DataFrame:
    """`stars`, and the least node of each component with itself. Nodes without a link don't appear."""
    found = stars(links)
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())

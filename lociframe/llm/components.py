"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import checkpoint


def _with_minimum(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and all its v; a table of minima is joined, so a hot u can be split."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("w")).select("u", "v", "m")


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has columns a, b. Returns (node, root), root the smallest node reachable; every node of an edge has a row.

    Loops and repeated edges are harmless, NULL ends are ignored, an empty table gives an empty one. Each round's edges
    are written to the checkpoint folder; the number of rounds grows with the logarithm of the longest chain.
    """
    pairs = checkpoint(edges.where("a is not null and b is not null and a <> b").select("a", "b").distinct())
    seen = None
    while True:
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        large = _with_minimum(both).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        small = _with_minimum(down)
        small = small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(small.select("u", "m"))
        pairs = checkpoint(small.where("a <> b").distinct())
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    roots = pairs.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)

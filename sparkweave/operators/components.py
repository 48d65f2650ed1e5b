"""Connected components by alternating large-star and small-star steps on edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from sparkweave.storage import dropped, written


def _large_star(edges: DataFrame) -> tuple[DataFrame, Observation]:
    """The step, and what its write sees of edges (a, b), a above b: open, where some vertex has two edges down, or one down and one up, so that they aren't stars yet."""
    both = edges.select("a", "b", F.lit(1).alias("down")).unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0).alias("down")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.sum("down").alias("down"), F.min("down").alias("none_up"))
    seen = Observation()
    least = least.observe(seen, F.max((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("none_up") == 0))).alias("open")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), seen


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(v, c): for links (a, b), each vertex but the roots with its component's least vertex.

    Nothing is collected; each step ends in a written table. The number of steps grows with the logarithm of
    the longest path."""
    edges = written(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not edges.isEmpty():
        step, seen = _large_star(edges)
        stars = written(step, "stars")
        if not seen.get["open"]:
            dropped([stars])
            break
        new = written(_small_star(stars), "edges")
        dropped([edges, stars])
        edges = new
    return edges.select(F.col("a").alias("v"), F.col("b").alias("c"))


def named_components(edges: DataFrame) -> DataFrame:
    """(v, c) of all vertices of edges (src, dst), roots included, as a written table."""
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    named = written(found.unionByName(found.select(F.col("c").alias("v"), "c")).distinct(), "components")
    dropped([found])
    return named

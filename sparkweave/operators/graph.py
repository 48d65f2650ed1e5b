"""The graph of contigs: built by joins from path ends, segment links and the contigs that hold a segment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.functions.sequences import flipped
from sparkweave.storage import written

#: Contigs of a segment beyond which it is split, and split segments that may be broadcast.
HUB, MOST_HUBS = 1000, 100_000


def contig_edges(paths: DataFrame, links: DataFrame, segments: DataFrame) -> DataFrame:
    """(src, dst), each edge both ways and once: paths (vid, start_seg, end_seg), links (seg_a, seg_b), segments (segment, vid)."""
    # What repeats within a path goes before its ends are rows; repeats among paths go with those of near.
    ends = paths.select(F.col("vid").alias("src"), F.explode(F.array_distinct(F.array("start_seg", flipped(F.col("start_seg")), "end_seg", flipped(F.col("end_seg"))))).alias("segment"))
    # Both directions come of one reading of the links, and go straight to the key that they meet on, where repeats end.
    turned = F.array(F.struct("seg_a", "seg_b"), F.struct(F.col("seg_b").alias("seg_a"), F.col("seg_a").alias("seg_b")))
    both = links.select(F.explode(turned).alias("l")).select("l.*").repartition("seg_a").distinct()
    # What no edge has goes at once: so near is the same plan where it is counted and where it is joined, and is made once.
    near = ends.join(both, F.col("segment") == F.col("seg_a")).select("src", F.col("seg_b").alias("segment")).filter("src IS NOT NULL AND segment IS NOT NULL").distinct()
    near, held = split_hubs(near, segments.select("segment", F.col("vid").alias("dst")).filter("segment IS NOT NULL AND dst IS NOT NULL"))
    return undirected(near.join(held, ["segment", "_i", "_j"]).filter("src <> dst"))


def split_hubs(near: DataFrame, held: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """near (src, segment) and held (segment, dst) with _i and _j, so that no key has more than about `hub` rows of either.

    The rows of a segment with more are dealt to parts on both sides, and each part of one side meets all parts of the other."""
    count = lambda df, name: df.groupBy("segment").agg(F.count(F.lit(1)).alias(name))
    many = count(near, "a").join(count(held, "b"), "segment").filter((F.col("a") > hub) | (F.col("b") > hub))
    many = many.select("segment", *[F.ceil(F.col(c) / hub).cast("int").alias(f"_{c}") for c in "ab"])
    if near.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":  # with it, a small table is broadcast by its true size
        many = written(many, "hubs")
        many = F.broadcast(many) if many.count() <= MOST_HUBS else many

    def dealt(df: DataFrame, by: str, own: str, mine: str, other: str, its: str) -> DataFrame:
        parts = df.join(many, "segment", "left")
        n, m = (F.coalesce(f"_{c}", F.lit(1)) for c in (mine, its))
        return parts.select("segment", by, F.pmod(F.xxhash64(by), n).cast("int").alias(own), F.explode(F.sequence(F.lit(0), m - 1)).alias(other))

    return dealt(near, "src", "_i", "a", "_j", "b"), dealt(held, "dst", "_j", "b", "_i", "a")


def undirected(edges: DataFrame) -> DataFrame:
    """(src, dst) both ways, without repeats and self-edges."""
    once = edges.filter("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.src", "e.dst")


def degrees(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, degree) of all vertices."""
    counted = edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("degree"))
    return vertices.select("vid").join(counted, "vid", "left").select("vid", F.coalesce("degree", F.lit(0)).alias("degree"))


def isolated(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    return vertices.join(edges.select(F.col("src").alias("vid")).distinct(), "vid", "left_anti")


def attach(vertices: DataFrame, coverages: DataFrame, probs: DataFrame | None = None, truth: DataFrame | None = None, profile: DataFrame | None = None) -> DataFrame:
    """vertices (vid, contig_id) with length and coverage, which must be there, and what else there is."""
    out = vertices.join(coverages.select("contig_id", "length", "coverage"), "contig_id", "left")
    for side in (probs, truth):
        if side is not None:
            out = out.join(side, "contig_id", "left")
    if truth is not None:
        out = out.withColumn("truth", F.coalesce("truth", F.lit("unclassified")))
    if profile is not None:
        out = out.join(profile, "contig_id", "left")
    return out

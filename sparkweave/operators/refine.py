"""Refinement: vertices take the majority label of their neighbours, one after another, until nothing changes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.operators.components import named_components
from sparkweave.operators.frontier import sweep_blocks
from sparkweave.storage import scratch, written

#: Edge rows that a task takes.
LARGEST = 400_000


def majority_sweep(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, label) after one sweep in which all vertices with two neighbours or more look at the same labels."""
    of = vertices.select(F.col("vid").alias("dst"), F.col("label").alias("near"))
    score = edges.join(of, "dst").groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("d"), F.count_if(F.col("near") == "chromosome").alias("c"), F.count_if(F.col("near") == "plasmid").alias("p"))
    new = F.when((F.col("d") > 1) & (F.col("c") > F.col("p")), "chromosome").when((F.col("d") > 1) & (F.col("p") > F.col("c")), "plasmid").otherwise(F.col("label"))
    return vertices.select("vid", "label").join(score, "vid", "left").select("vid", new.alias("label"))


def leaf_copy(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, label) after each vertex with one neighbour has taken that one's label, if it has one.

    Leaves go in order of their ids, which matters only where two leaves face each other: both then have the
    higher one's label if it is classified, else the lower one's."""
    leaf = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"), F.min("dst").alias("dst")).filter("d = 1").select(F.col("src").alias("vid"), "dst")
    facing = leaf.join(leaf.select(F.col("vid").alias("dst"), F.col("dst").alias("vid"), F.lit(True).alias("facing")), ["vid", "dst"], "left")
    of = vertices.select(F.col("vid").alias("dst"), F.col("label").alias("near"))
    met = vertices.select("vid", "label").join(facing.join(of, "dst"), "vid", "left")
    other = F.when(F.col("near") != "unclassified", F.col("near")).otherwise(F.col("label"))
    own = F.when(F.col("label") != "unclassified", F.col("label")).otherwise(F.col("near"))
    return met.select("vid", F.when(F.col("dst").isNull(), F.col("label")).when(F.col("facing") & (F.col("vid") > F.col("dst")), own).otherwise(other).alias("label"))


def _swept(src: np.ndarray, dst: np.ndarray, sign: np.ndarray) -> np.ndarray:
    """Signs of vertices 0, 1, ... at the fixpoint of sweeps in their order; edges are sorted by src.

    Only vertices with a neighbour that changed since their last turn are looked at again."""
    n = len(sign)
    cut = np.searchsorted(src, np.arange(n + 1)).tolist()
    near = dst.tolist()
    total = np.bincount(src, sign[dst], n).astype(np.int64).tolist()
    now, later, sign = list(range(n)), set(), sign.tolist()
    waiting = set(now)
    while now:
        while now:
            v = heapq.heappop(now)
            waiting.discard(v)
            s = (total[v] > 0) - (total[v] < 0)
            if cut[v + 1] - cut[v] > 1 and s and s != sign[v]:
                step, sign[v] = s - sign[v], s
                for u in near[cut[v] : cut[v + 1]]:
                    total[u] += step
                    if u < v:
                        later.add(u)
                    elif u not in waiting:
                        waiting.add(u)
                        heapq.heappush(now, u)
        now, later = sorted(later), set()
        waiting = set(now)
    return np.array(sign)


def refine(vertices: DataFrame, edges: DataFrame, largest: int = LARGEST, components: DataFrame | None = None) -> DataFrame:
    """(vid, label) at the fixpoint of sequential majority sweeps in order of ids, then leaf copy.

    Components are independent and are swept side by side, many in one task; those with more than `largest` edge rows go
    in blocks, by an active frontier.
    Every change lets more edges join equal labels, so the sweeps end.
    components (v, c) are named_components() of edges, where these are a written table and its components are known."""
    with scratch() as keep:
        edges = written(edges, "edges") if components is None else edges
        components = named_components(edges) if components is None else components
        return keep(_refined(vertices, edges, largest, components), "refined")


def _refined(vertices: DataFrame, edges: DataFrame, largest: int, components: DataFrame) -> DataFrame:
    named = components.withColumnRenamed("v", "src")
    sized = written(edges.join(named, "src").groupBy("c").agg(F.count(F.lit(1)).alias("n")), "sizes")
    small, total, big = sized.agg(F.count_if(F.col("n") <= largest), F.sum(F.when(F.col("n") <= largest, F.col("n"))), F.count_if(F.col("n") > largest)).first()
    groups = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * (total or 0) // largest))
    label = vertices.select(F.col("vid").alias("src"), "label")
    here = named.join(sized.filter(F.col("n") <= largest), "c").select("src", F.pmod(F.xxhash64("c"), F.lit(groups)).alias("_g"))
    rows = edges.join(here, "src").join(label, "src")

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("src", kind="stable")
        ids, at = np.unique(pdf["src"].to_numpy(), return_inverse=True)
        sign = np.zeros(len(ids), np.int64)
        sign[at] = pdf["label"].map({"plasmid": 1, "chromosome": -1}).fillna(0)
        new = _swept(at, np.searchsorted(ids, pdf["dst"]), sign)
        return pd.DataFrame({"vid": ids, "swept": np.array(["chromosome", "unclassified", "plasmid"])[new + 1]})

    swept = rows.repartition(groups, "_g").groupBy("_g").applyInPandas(sweep, "vid long, swept string")
    if big:
        own = named.join(sized.filter(F.col("n") > largest), "c", "left_semi").select("src")
        sign = F.when(F.col("label") == "plasmid", 1).when(F.col("label") == "chromosome", -1).otherwise(0)
        signs, _ = sweep_blocks(vertices.join(own.withColumnRenamed("src", "vid"), "vid", "left_semi").select("vid", sign.alias("sign")), edges.join(own, "src", "left_semi"), largest)
        swept = swept.unionByName(signs.select("vid", F.element_at(F.array(F.lit("chromosome"), F.lit("unclassified"), F.lit("plasmid")), F.col("sign") + 2).alias("swept")))
    out = vertices.select("vid", "label").join(swept, "vid", "left").select("vid", F.coalesce("swept", "label").alias("label"))
    return leaf_copy(out, edges)

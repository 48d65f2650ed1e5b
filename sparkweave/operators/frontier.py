"""Sweeps in order of ids over components that no task could hold: blocks of vertices and an active frontier.

In a sweep a vertex looks at the new labels of its lower neighbours and at the old ones of its higher neighbours. Vertices
are cut into blocks, and a task takes a block with copies of the labels around it and goes through its vertices in
order. It does so with what is known of lower blocks; where these change a label afterwards, the copies are told, and
only blocks that were told something are gone through again, in the next round. A vertex is right as soon as the lower
ones are, so this ends with what one pass through all vertices gives. In a block only vertices are looked at that have a neighbour
that differs from what they saw at their last turn; in later sweeps most blocks aren't read at all.

A vertex with more neighbours than a block has edges is a block of its own, whose neighbours are added up without a task that holds
them. Edges and copies are written once by block; what travels are labels that changed."""

from __future__ import annotations

import functools
import heapq
import logging

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.storage import dropped, scratch, written

log = logging.getLogger("sparkweave")
#: Tables of labels told in a sweep before they are put together.
MOST_TOLD = 12


def blocks(edges: DataFrame, largest: int) -> DataFrame:
    """(vid, block, center) of all vertices of edges (src, dst), both ways: blocks of neighbouring ids with about `largest` edges, each counted half at both ends.

    center is the vertex itself where it has more than these."""
    degree = edges.groupBy(F.col("src").alias("vid")).agg(F.count(F.lit(1)).alias("d"))
    ranged = written(degree.repartitionByRange("vid").select("vid", "d", F.spark_partition_id().alias("part")), "ranges")
    few = F.when(F.col("d") <= 2 * largest, F.col("d")).otherwise(0)
    sums = ranged.groupBy("part").agg(F.sum(few).alias("n")).withColumn("before", F.expr("sum(n) OVER (ORDER BY part) - n")).select("part", "before")  # one row per task
    upto = ranged.withColumn("few", few).join(sums, "part").withColumn("upto", F.expr("before + sum(few) OVER (PARTITION BY part ORDER BY vid ROWS UNBOUNDED PRECEDING)"))
    own = F.col("d") > 2 * largest
    name = F.when(own, F.concat(F.lit("h"), F.col("vid").cast("string"))).otherwise(F.concat(F.lit("b"), F.floor((F.col("upto") - F.col("few")) / (2 * largest)).cast("string")))
    return upto.select("vid", name.alias("block"), F.when(own, F.col("vid")).alias("center"))


def swept_block(adj: pd.DataFrame, cells: pd.DataFrame, first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of a block, and their new labels where these differ from what the table has.

    adj: (src, dst) of the block's vertices; cells: (vid, own, older, old, new) of these and of the vertices around them."""
    cells = cells.sort_values("vid")
    ids, own = cells["vid"].to_numpy(), cells["own"].to_numpy(bool)
    older, old, new = (cells[c].to_numpy(np.int64) for c in ("older", "old", "new"))
    v, u = np.searchsorted(ids, adj["src"].to_numpy()), np.searchsorted(ids, adj["dst"].to_numpy())
    order = np.lexsort((u, v))
    v, u = v[order], u[order]
    cut = np.searchsorted(v, np.arange(len(ids) + 1)).tolist()
    lower = u < v
    seen = np.where(lower & ~own[u], new[u], old[u])  # lower vertices of the block follow as they change
    total = np.bincount(v, seen, len(ids)).astype(np.int64).tolist()
    stale = np.where(lower, ~own[u] & (new[u] != old[u]), old[u] != older[u])
    todo = np.flatnonzero(own & (np.bincount(v, stale, len(ids)) > 0)) if not first else np.flatnonzero(own)
    now, waiting, near, sign = todo.tolist(), set(todo.tolist()), u.tolist(), old.tolist()
    mine = own.tolist()
    while now:
        x = heapq.heappop(now)
        s = (total[x] > 0) - (total[x] < 0)
        if cut[x + 1] - cut[x] > 1 and s and s != sign[x]:
            step, sign[x] = s - sign[x], s
            for y in near[cut[x] : cut[x + 1]]:
                if y > x and mine[y]:
                    total[y] += step
                    if y not in waiting:
                        waiting.add(y)
                        heapq.heappush(now, y)
    got = np.array(sign)
    told = own & (got != new)
    return ids[told], got[told]


def _changes(adj: DataFrame, cells: DataFrame, first: bool) -> DataFrame:
    """(vid, new): what the blocks of cells change."""

    def sweep(a: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        vid, new = swept_block(a, c, first) if len(c) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        return pd.DataFrame({"vid": vid, "new": new.astype(np.int32)})

    in_blocks = adj.groupBy("block").cogroup(cells.filter("center IS NULL").groupBy("block")).applyInPandas(sweep, "vid long, new int")
    around = F.sum(F.when(~F.col("own"), F.when(F.col("vid") < F.col("center"), F.col("new")).otherwise(F.col("old"))))
    alone = cells.filter("center IS NOT NULL").groupBy("center").agg(around.alias("s"), F.max(F.when(F.col("own"), F.col("old"))).alias("old"), F.max(F.when(F.col("own"), F.col("new"))).alias("was"))
    alone = alone.select(F.col("center").alias("vid"), F.when(F.col("s") == 0, F.col("old")).otherwise(F.signum("s").cast("int")).alias("new"), "was").filter("new <> was").drop("was")
    return in_blocks.unionByName(alone)


def _latest(told: list[DataFrame]) -> DataFrame:
    """(block, vid, new): of labels that were told more than once the last one."""
    rows = [t.select("block", "vid", "new", F.lit(k).alias("at")) for k, t in enumerate(told)]
    return functools.reduce(DataFrame.unionByName, rows).groupBy("block", "vid").agg(F.max_by("new", "at").alias("new"))


def _one_sweep(cells: DataFrame, adj: DataFrame, first: bool) -> tuple[list[DataFrame], int]:
    """Tables (block, vid, own, new) of the labels that a sweep changes, later ones counting more, and its rounds."""
    homes, told, rounds = cells.select("block", "vid", "own"), [], 0
    active = None if first else cells.filter("old <> older").select("block").distinct()
    while True:
        here, near = (x if active is None else x.join(active, "block", "left_semi") for x in (cells, adj))
        if told:
            news = _latest([t.join(active, "block", "left_semi") for t in told]).withColumnRenamed("new", "_new")
            here = here.join(news, ["block", "vid"], "left").withColumn("new", F.coalesce("_new", "new")).drop("_new")
        last = written(homes.join(_changes(near, here, first), "vid").select("block", "vid", "own", "new"), "told")
        rounds += 1
        if last.isEmpty():
            return told, rounds
        told.append(last)
        active = last.filter("NOT own").select("block").distinct()
        if len(told) == MOST_TOLD:  # shorter plans
            told = [written(_latest(told[:-1]), "told"), last]


def sweep_blocks(signs: DataFrame, edges: DataFrame, largest: int) -> tuple[DataFrame, int]:
    """(vid, sign) at the fixpoint of sweeps over signs (vid, sign) and edges (src, dst), both ways, and the number of rounds that it took."""
    with scratch() as keep:
        of = written(blocks(edges, largest), "blocks")
        rows = edges.join(of.withColumnRenamed("vid", "src"), "src").select("block", "center", "src", "dst")
        rows = written(rows.repartition("block").sortWithinPartitions("block"), "adjacent")
        around = rows.select("block", "center", F.col("dst").alias("vid")).distinct().join(of.select(F.col("block").alias("home"), "vid"), "vid").filter("block <> home")
        cells = around.select("vid", "block", "center", F.lit(False).alias("own")).unionByName(of.select("vid", "block", "center", F.lit(True).alias("own"))).join(signs, "vid")
        cells = cells.select("block", "center", "vid", "own", *[F.col("sign").cast("int").alias(c) for c in ("older", "old", "new")])
        cells = written(cells.repartition("block").sortWithinPartitions("block"), "cells")
        adj, rounds, first = rows.filter("center IS NULL").select("block", "src", "dst"), 0, True
        while True:
            told, took = _one_sweep(cells, adj, first)
            rounds, first = rounds + took, False
            if not told:
                log.debug("sweeps in blocks: %d rounds", rounds)
                return keep(cells.filter("own").select("vid", F.col("old").alias("sign")), "swept"), rounds
            moved = cells.join(_latest(told).withColumnRenamed("new", "_new"), ["block", "vid"], "left")
            was, cells = cells, written(moved.select("block", "center", "vid", "own", F.col("old").alias("older"), *[F.coalesce("_new", "old").alias(c) for c in ("old", "new")]).sortWithinPartitions("block"), "cells")
            dropped([was, *told])

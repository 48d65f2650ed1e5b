"""Label propagation on the contig graph, and its weighted form on directed edges.

Every labelled vertex is a class of its own. A step multiplies by the row-normalised adjacency (weights rounded
to single precision); a labelled vertex then gets its own class back to 1, all else it has stays as it
came, and the other vertices' rows are normalised. Components don't mix, but the stop test is one for all: so
components are solved side by side, many in one task, each until its state repeats exactly, which gives all further steps, or to the most steps; only where the
sum of all changes falls below the limit earlier, they are solved once more for exactly that number of steps. Only components whose steps add up more
than LARGEST numbers, which would not fit a task, run as joins: edges and states lie in buckets by the vertex on which they
meet, so that a step moves the new state once and edges never. What a step changes is observed as it is written.

The weighted form is linear in the scores of unlabelled vertices, so only what a step changed goes through the edges in the next.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from sparkweave.operators.components import named_components
from sparkweave.storage import bucketed, dropped, scratch, written

EPSILON, MOST_STEPS, LARGEST = 1e-5, 1000, 4_000_000
#: Groups of components for each shuffle partition, at least, so that tasks end side by side.
GROUPS = 4
#: Numbers in the states of components that are stepped together, steps between looks at which of them rest, and neighbours of a vertex that are added one by one.
BATCH, LOOK, NEAR = 131_072, 8, 8
#: Tables of what steps changed before they are added up.
MOST_GATHERED = 16


def transition_weights(edges: DataFrame) -> DataFrame:
    """(src, dst, w): one over the degree, in single precision."""
    degree = edges.groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    return edges.join(degree, "src").select("src", "dst", (F.lit(1.0) / F.col("d")).cast("float").cast("double").alias("w"))


def start(labelled: DataFrame, edges: DataFrame) -> DataFrame:
    """(vid, cls, p): each labelled vertex (vid) with an edge is sure of its own class."""
    return labelled.select("vid").join(edges.select(F.col("src").alias("vid")).distinct(), "vid", "left_semi").select("vid", F.col("vid").alias("cls"), F.lit(1.0).alias("p"))


def propagation_step(weights: DataFrame, state: DataFrame, seeds: DataFrame) -> DataFrame:
    """One step of state (vid, cls, p); seeds is the start state, and part of every state."""
    return _step(weights, state, seeds).filter("p > 0").select("vid", "cls", "p")


def _step(weights: DataFrame, state: DataFrame, seeds: DataFrame, buckets: int | None = None) -> DataFrame:
    """(vid, cls, p, was): a step of state and what it had before; p is 0 where nothing is left. With buckets, rows move to these once."""
    moved = weights.join(state, weights["dst"] == state["vid"]).select(weights["src"].alias("vid"), "cls", (F.col("w") * F.col("p")).alias("p"), F.lit(0.0).alias("was"))
    both = moved.unionByName(state.select("vid", "cls", F.lit(0.0).alias("p"), F.col("p").alias("was")))
    if buckets:
        both = both.repartition(buckets, "vid")
    summed = both.groupBy("vid", "cls").agg(F.sum("p").alias("p"), F.sum("was").alias("was"))
    marked = summed.join(seeds.select("vid", F.lit(True).alias("known")), "vid", "left").withColumn("_all", F.sum("p").over(Window.partitionBy("vid")))
    free = F.when(F.col("_all") > 0, F.col("p") / F.col("_all")).otherwise(0.0)
    return marked.select("vid", "cls", F.when(F.col("known") & (F.col("vid") == F.col("cls")), 1.0).when(F.col("known"), F.col("p")).otherwise(free).alias("p"), "was")


def observed(df: DataFrame, change: Column) -> tuple[DataFrame, Observation]:
    """df, and what its next write adds up of change."""
    seen = Observation()
    return df.observe(seen, F.sum(F.abs(change)).alias("change")), seen


def propagate_steps(edges: DataFrame, labelled: DataFrame, steps: int) -> DataFrame:
    """(vid, cls, p) after a fixed number of steps."""
    weights, state, seeds = _before(edges, labelled, steps)
    return propagation_step(weights, state, seeds) if steps else state


def change_of_step(edges: DataFrame, labelled: DataFrame, step: int) -> DataFrame:
    """(change): the sum of all changes of a step, which knows what there was before; nothing is joined for it."""
    return _step(*_before(edges, labelled, step)).agg(F.sum(F.abs(F.col("p") - F.col("was"))).alias("change"))


def _before(edges: DataFrame, labelled: DataFrame, step: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weights, the state before a step, written, and the start state."""
    edges = written(edges, "edges")
    weights, seeds = written(transition_weights(edges), "weights"), written(start(labelled, edges), "seeds")
    state = seeds
    for k in range(step - 1):
        new = written(propagation_step(weights, state, seeds), "propagation")
        if k:
            dropped([state])
        state = new
    return weights, state, seeds


def _after(pdf: pd.DataFrame, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of components (src, dst, known, c) with all their edges: vertices, classes and shares after so many steps, and the sum of changes in each step.

    Components with as many classes are stepped in batches that stay in a core's cache, vertices of many neighbours first."""
    ids, at = np.unique(pdf["src"].to_numpy(), return_inverse=True)
    to = np.searchsorted(ids, pdf["dst"])
    known, part = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
    known[at], part[at] = pdf["known"], pd.factorize(pdf["c"])[0]
    degree, wide = np.bincount(at), np.bincount(part, known).astype(np.int64)  # classes of each component
    order = np.argsort(wide, kind="stable")
    full = np.cumsum((wide * np.bincount(part))[order]) // BATCH
    batch = np.zeros(len(wide), np.int64)
    batch[order] = np.cumsum((np.diff(wide[order], prepend=wide[order[0]]) != 0) | (np.diff(full, prepend=full[0]) != 0))
    # Vertices by batch and falling degree, edges by the vertex that they add to.
    vertices = np.lexsort((-degree, batch[part]))
    place = np.argsort(vertices)
    ids, known, part, degree = ids[vertices], known[vertices], part[vertices], degree[vertices]
    at, to = place[at], place[to]
    order = np.argsort(at, kind="stable")
    at, to = at[order], to[order]
    ends = np.searchsorted(batch[part], np.arange(batch.max() + 2))
    changes, found = np.zeros(steps), []
    for lo, hi, first, last in zip(ends[:-1], ends[1:], np.searchsorted(at, ends[:-1]), np.searchsorted(at, ends[1:]), strict=True):
        own = slice(lo, hi)
        found.append(_batch_after(ids[own], known[own], part[own], degree[own], at[first:last] - lo, to[first:last] - lo, int(wide[part[lo]]), steps, changes))
    return *(np.concatenate(x) for x in zip(*found, strict=True)), changes


def _batch_after(ids: np.ndarray, known: np.ndarray, part: np.ndarray, degree: np.ndarray, at: np.ndarray, to: np.ndarray, k: int, steps: int, changes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vertices, classes and shares of components with k classes each; adds to changes. A state has a line for each class of a component.

    A component rests when its state is that of two steps before: then it is known for all later steps, and the others go on without it."""
    part = np.unique(part, return_inverse=True)[1]
    teach = np.flatnonzero(known)
    teach = teach[np.lexsort((ids[teach], part[teach]))]
    classes = ids[teach].reshape(-1, k)
    rank = np.zeros(len(ids), np.int64)
    rank[teach] = np.arange(len(teach)) % k
    w = (1 / degree).astype(np.float32).astype(float)
    y = np.zeros((k, len(ids)))
    y[rank[teach], teach] = 1
    free, was, out = ~known, None, []
    near, far = _neighbours(at, to)
    for step in range(1, steps + 1):
        new = w * y.take(near[0], axis=1)
        for more in near[1:]:
            new[:, : len(more)] += w[: len(more)] * y.take(more, axis=1)
        if far:
            hubs, starts, more, of = far
            new[:, hubs] += np.add.reduceat(w[of] * y.take(more, axis=1), starts, axis=1)
        new[rank[teach], teach] = 1
        total = new.sum(0)
        new /= np.where(free & (total > 0), total, 1.0)
        moved = np.abs(new - y)
        changes[step - 1] += moved.sum()
        was, y, before = y, new, was
        # At rest or between two states: the one that also the last step would give.
        if step < steps and before is not None and (steps - step) % LOOK == 0:
            moving = np.bincount(part, (y != before).any(0)) > 0
            rests = ~moving[part]
            if rests.all() or rests.sum() > len(rests) // 8:
                changes[step:] += moved[:, rests].sum()
                out.append((ids[rests], classes[part[rests]], y[:, rests].T))
                if rests.all():
                    return _rows(out)
                stays = ~rests
                place = np.cumsum(stays) - 1
                at, to = place[at[stays[at]]], place[to[stays[at]]]
                ids, part, w, rank, free, y, was = ids[stays], part[stays], w[stays], rank[stays], free[stays], y[:, stays], was[:, stays]
                classes, part = classes[moving], (np.cumsum(moving) - 1)[part]
                teach = np.flatnonzero(~free)
                near, far = _neighbours(at, to)
    out.append((ids, classes[part], y.T))
    return _rows(out)


def _rows(states: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vertex, class, share) of states with a line for each vertex, where there is a share."""
    ids, classes, y = (np.concatenate(x) for x in zip(*states, strict=True))
    on = y > 0
    return np.broadcast_to(ids[:, None], y.shape)[on], classes[on], y[on]


def _neighbours(at: np.ndarray, to: np.ndarray) -> tuple[list[np.ndarray], tuple[np.ndarray, ...] | None]:
    """Of edges in order of at, where vertices have falling degrees: the first neighbours of all, the second of those that have one, and so on;
    then of hubs with still more the vertices, where their edges begin, and these."""
    turn = np.arange(len(at)) - np.searchsorted(at, at)
    near = [to[turn == i] for i in range(min(NEAR, turn.max() + 1))]
    rest = np.flatnonzero(turn >= NEAR)
    if not len(rest):
        return near, None
    hubs, starts = np.unique(at[rest], return_index=True)
    return near, (hubs, starts, to[rest], at[rest])


def _components(edges: DataFrame, known: DataFrame, named: DataFrame) -> DataFrame:
    """(v, c, known, cost) of all vertices with an edge, named (v, c): component, whether it is labelled, and the numbers that a step of it adds up."""
    degree = edges.groupBy(F.col("src").alias("v")).agg(F.count(F.lit(1)).alias("d"))
    marked = named.join(known, "v", "left").select("v", "c", F.coalesce("known", F.lit(False)).alias("known"))
    sized = marked.join(degree, "v").groupBy("c").agg((F.sum("d") * F.count_if("known")).alias("cost"))
    return marked.join(sized, "c")


def propagate(edges: DataFrame, labelled: DataFrame, epsilon: float = EPSILON, most: int = MOST_STEPS, largest: int = LARGEST, components: DataFrame | None = None) -> DataFrame:
    """(vid, cls, p) with p > 0, after as many steps as the stop test takes.

    components (v, c) are named_components() of edges, where these are a written table and its components are known."""
    with scratch() as keep:
        edges = written(edges, "edges") if components is None else edges
        components = named_components(edges) if components is None else components
        return _propagated(edges, labelled, epsilon, most, largest, components, keep)


def _propagated(edges: DataFrame, labelled: DataFrame, epsilon: float, most: int, largest: int, components: DataFrame, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    spark = edges.sparkSession
    known = labelled.select(F.col("vid").alias("v"), F.lit(True).alias("known"))
    named = written(_components(edges, known, components), "named").filter("cost > 0")
    small = named.filter(F.col("cost") <= largest)
    # As many groups of components as tasks of bounded cost hold; their rows are few bytes, but much work.
    count, cost = small.filter("v = c").agg(F.count(F.lit(1)), F.sum("cost")).first()
    groups = max(GROUPS * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * (cost or 0) // largest))
    parts = edges.join(small.select(F.col("v").alias("src"), "c", "known"), "src").withColumn("_g", F.pmod(F.xxhash64("c"), F.lit(groups)))

    def solved(steps: int) -> DataFrame:
        """(vid, cls, p, changes) of the small components after so many steps, and on one row of a group the sum of its changes in each of them."""

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            ids, classes, p, changes = _after(pdf, steps)
            return pd.DataFrame({"vid": ids, "cls": classes, "p": p, "changes": pd.Series([changes.tolist()] + [None] * (len(ids) - 1), dtype=object)})

        return keep(parts.repartition(groups, "_g").groupBy("_g").applyInPandas(solve, "vid long, cls long, p double, changes array<double>"), "propagated")

    # Mostly the most steps are gone, and this is the state; else it tells how many there are.
    state, summed, steps = None, {}, most
    if count:
        state = solved(most)
        summed = {r["pos"] + 1: r["d"] for r in state.select(F.posexplode("changes")).groupBy("pos").agg(F.sum("col").alias("d")).collect()}  # a row for each step
        steps = next((t for t in sorted(summed) if summed[t] <= epsilon), most)
    big, out = named.filter(F.col("cost") > largest), None
    if not big.isEmpty():
        own = big.select(F.col("v").alias("src"))
        out, steps = _propagate_joined(edges.join(own, "src", "left_semi"), labelled.join(own.withColumnRenamed("src", "vid"), "vid", "left_semi"), epsilon, most, summed)
        out = keep(out.select("vid", "cls", "p"), "joined")
    if state is None:
        return out if out is not None else spark.createDataFrame([], "vid long, cls long, p double")
    if steps != most:
        dropped([state])
        state = solved(steps)
    state = state.select("vid", "cls", "p")
    return state if out is None else state.unionByName(out)


def _propagate_joined(edges: DataFrame, labelled: DataFrame, epsilon: float, most: int, others: dict[int, float] | None = None) -> tuple[DataFrame, int]:
    """The state and the number of steps, where others, components solved elsewhere, change by so much in each step."""
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    weights, seeds = bucketed(transition_weights(edges), "weights", "dst", n), bucketed(start(labelled, edges), "seeds", "vid", n)
    state, step = seeds, 0
    for step in range(1, most + 1):
        new, seen = observed(_step(weights, state, seeds, n), F.col("p") - F.col("was"))
        old, state = state, bucketed(new.filter("p > 0").select("vid", "cls", "p"), "propagation", "vid", n)
        if old is not seeds:
            dropped([old])
        if (seen.get["change"] or 0.0) + (others or {}).get(step, 0.0) <= epsilon:
            break
    return state, step


# ---- weighted form: records (vid, label, edges array<struct<dest, weight>>), label 0 for none

def record_edges(records: DataFrame) -> DataFrame:
    """(src, dst, weight); a destination without a record is an error."""
    edges = records.select(F.col("vid").alias("src"), F.explode("edges").alias("e")).select("src", F.col("e.dest").alias("dst"), F.col("e.weight").alias("weight"))
    lost = edges.join(records.select(F.col("vid").alias("dst")), "dst", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"the edge to {lost[0]['dst']} leads to no vertex")
    return edges


def weighted_start(records: DataFrame) -> DataFrame:
    return records.filter("label <> 0").select("vid", "label", F.lit(1.0).alias("score"))


def weighted_shares(records: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, share) of the edges into unlabelled vertices: an edge's weight over the out-weight of the vertex that it leads to."""
    out = edges.groupBy(F.col("src").alias("vid")).agg(F.sum("weight").alias("deg"))
    free = records.filter("label = 0").select("vid").join(out, "vid")
    return edges.join(free.withColumnRenamed("vid", "dst"), "dst").select("src", "dst", (F.col("weight") / F.col("deg")).alias("share"))


def weighted_step(shares: DataFrame, state: DataFrame) -> DataFrame:
    """Scores (vid, label, score) that unlabelled vertices get from state through their in-edges."""
    into = shares.join(state.select(F.col("vid").alias("src"), "label", "score"), "src")
    return into.groupBy(F.col("dst").alias("vid"), "label").agg(F.sum(F.col("score") * F.col("share")).alias("score"))


def weighted_propagation(records: DataFrame, epsilon: float, most: int) -> DataFrame:
    """(vid, label, score) once a step changes less than epsilon, or after the most steps.

    As the shares stay, what a step adds is what goes through the edges in the next one; scores that came to rest don't travel."""
    with scratch() as keep:
        records = written(records, "records")
        shares = written(weighted_shares(records, record_edges(records)), "shares")
        state, delta = weighted_start(records), weighted_start(records)
        gathered = [state]
        for _ in range(most):
            moved, seen = observed(weighted_step(shares, delta), F.col("score"))
            delta = written(moved.filter("score <> 0"), "delta")
            gathered.append(delta)
            if (seen.get["change"] or 0.0) < epsilon:
                break
            if len(gathered) == MOST_GATHERED:  # shorter plans
                gathered = [written(_added(gathered), "weighted")]
        return keep(_added(gathered), "weighted")


def _added(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts).groupBy("vid", "label").agg(F.sum("score").alias("score"))


def best_labels(records: DataFrame, state: DataFrame) -> DataFrame:
    """(vid, label, score): the first of the labels with the highest score; a vertex that nothing reached has the lowest label and 0."""
    lowest = records.filter("label <> 0").agg(F.min("label").alias("_low"))
    best = state.filter("score > 0").groupBy("vid").agg(F.max_by(F.struct("label", "score"), F.struct("score", (-F.col("label")).alias("l"))).alias("b"))
    return records.select("vid").join(best, "vid", "left").join(F.broadcast(lowest), F.lit(True)).select("vid", F.coalesce("b.label", "_low").alias("label"), F.coalesce("b.score", F.lit(0.0)).alias("score"))


def clean_scores(state: DataFrame, best: DataFrame) -> DataFrame:
    """(vid, label, score): the sum of a vertex's scores, without vertices where it is 0."""
    total = state.groupBy("vid").agg(F.sum("score").alias("score")).filter("score <> 0")
    return best.select("vid", "label").join(total, "vid")

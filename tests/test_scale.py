"""What keeps plans even and small where data grow: split hubs, bucketed steps, pruned neighbours, sketched ranks."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.operators import components, graph, neighbours, propagation, refine, thresholds, topology
from sparkweave.plans import refinement
from sparkweave.storage import bucketed, scratch


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_a_segment_of_many_contigs_is_dealt_to_parts(spark, adaptive):
    rng = random.Random(1)
    near = [(i, "hub" if i < 20_000 else f"s{i}") for i in range(26_000)]
    held = [("hub" if i < 9_000 else f"s{rng.randrange(20_000, 26_000)}", 100_000 + i) for i in range(12_000)]
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        a, b = graph.split_hubs(spark.createDataFrame(near, "src long, segment string"), spark.createDataFrame(held, "segment string, dst long"))
        for df, n, times in ((a, 26_000, 9), (b, 12_000, 20)):
            sizes = [r["count"] for r in df.groupBy("segment", "_i", "_j").count().collect()]
            assert max(sizes) < 2 * graph.HUB and sum(sizes) == n + (times - 1) * (20_000 if times == 9 else 9_000)
        few = b.filter("segment <> 'hub' OR dst < 100003")
        met = a.join(few, ["segment", "_i", "_j"]).count()
        want = 3 * 20_000 + sum(s != "hub" for s, _ in held)
        assert met == want
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_edges_with_a_hub_equal_a_plain_join(spark, monkeypatch):
    monkeypatch.setattr(graph.split_hubs, "__defaults__", (4,))
    rng = random.Random(2)
    paths = [(i, f"{rng.randrange(6)}+", f"{rng.randrange(40)}-") for i in range(60)]
    links = [(f"{rng.randrange(6)}{rng.choice('+-')}", f"{rng.randrange(40)}{rng.choice('+-')}") for _ in range(50)]
    segments = [(s, i) for i, a, b in paths for s in (a, b)]
    got = graph.contig_edges(spark.createDataFrame(paths, "vid long, start_seg string, end_seg string"), spark.createDataFrame(links, "seg_a string, seg_b string"), spark.createDataFrame(segments, "segment string, vid long"))
    flip = lambda s: s[:-1] + ("-" if s[-1] == "+" else "+")
    both = {(a, b) for a, b in links} | {(b, a) for a, b in links}
    want = set()
    for i, a, b in paths:
        for end in (a, flip(a), b, flip(b)):
            want |= {(i, j) for x, y in both if x == end for s, j in segments if s == y and i != j}
    assert {tuple(r) for r in got.collect()} == want | {(b, a) for a, b in want}


def test_a_step_moves_the_state_once_and_edges_never(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        with scratch():
            pairs = spark.range(300).selectExpr("id AS src", "id + 1 AS dst")
            edges = graph.undirected(pairs)
            weights = bucketed(propagation.transition_weights(edges), "weights", "dst", n)
            seeds = bucketed(propagation.start(spark.range(0, 300, 50).withColumnRenamed("id", "vid"), edges), "seeds", "vid", n)
            step = propagation._step(weights, seeds, seeds, n)
            plan = step._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning(") == 1 and "REPARTITION_BY_NUM" in plan
            seen, got = propagation.observed(step, F.col("p") - F.col("was"))[::-1]
            rows = got.collect()
            assert seen.get["change"] == pytest.approx(sum(abs(r["p"] - r["was"]) for r in rows))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("metric", ["joint", "euclid"])
def test_pairs_looked_at_grow_less_than_their_number(spark, metric):
    rng = np.random.default_rng(3)
    scale = 20 if metric == "joint" else 1

    def rows(n):
        x = rng.random((n, 4)) / scale
        c = rng.integers(5, 60, n) / (1 if metric == "joint" else 60)
        return [(i, [*map(float, a), float(b)]) for i, (a, b) in enumerate(zip(x, c, strict=True))]

    seen = []
    for n in (1000, 4000):
        train = spark.createDataFrame([(i, x, "plasmid") for i, x in rows(n)], "nbr long, x array<double>, label string")
        asked = spark.createDataFrame([(i, x) for i, x in rows(n)], "vid long, x array<double>")
        met, every = neighbours.pairs_looked_at(asked, train, metric, block=128)
        assert every == n * n and met < 0.6 * every
        seen.append(met)
    assert seen[1] < 12 * seen[0]  # sixteen times as many pairs


@pytest.mark.parametrize("kind", ["few", "ties", "many"])
def test_thresholds_equal_a_sort(spark, kind, monkeypatch):
    if kind == "many":  # brackets with too many values
        monkeypatch.setattr(thresholds, "FEW", 3)
    rng = random.Random(kind)
    values = [rng.choice([0.5, 0.75, 0.2, 1.0, 0.0]) if kind == "ties" else rng.random() for _ in range(3000)] + [None, 0.5]
    df = spark.createDataFrame([(v,) for v in values], "prob double")
    for classifier, (up, down) in thresholds.SHARES.items():
        high, low = sorted((v for v in values if v is not None and v >= 0.5), reverse=True), sorted(v for v in values if v is not None and v < 0.5)
        want = high[round(up * len(high)) - 1], low[round(down * len(low)) - 1]
        assert thresholds.probability_thresholds(df, classifier) == want


@pytest.mark.parametrize("metric", ["joint", "euclid"])
def test_rows_that_a_query_meets_do_not_grow_with_the_tables(spark, metric):
    rng = np.random.default_rng(5)
    seen = []
    for n in (2000, 16_000):
        x = np.hstack([rng.random((n, 2)) / (20 if metric == "joint" else 1), rng.integers(5, 60, (n, 1)) / (1 if metric == "joint" else 60)]).tolist()
        train = spark.createDataFrame([(i, r, "plasmid") for i, r in enumerate(x)], "nbr long, x array<double>, label string")
        asked = spark.createDataFrame([(i, r) for i, r in enumerate(x[:1000])], "vid long, x array<double>")
        met, _ = neighbours.pairs_looked_at(asked, train, metric, block=64)
        seen.append(met)
    assert seen[1] < 3 * seen[0]  # eight times as many pairs


@pytest.mark.parametrize("step", [1, 3])
def test_the_change_of_a_step_needs_no_second_run(spark, step):
    edges = graph.undirected(spark.range(40).selectExpr("id AS src", "id * 7 % 11 + id + 1 AS dst"))
    known = spark.range(0, 40, 5).withColumnRenamed("id", "vid")
    new, old = ({(r["vid"], r["cls"]): r["p"] for r in propagation.propagate_steps(edges, known, k).collect()} for k in (step, step - 1))
    got = propagation.change_of_step(edges, known, step).first()["change"]
    assert got == pytest.approx(sum(abs(new.get(x, 0) - old.get(x, 0)) for x in new.keys() | old.keys()))


def test_path_ends_are_not_exchanged_before_they_meet_links(spark):
    paths = spark.createDataFrame([(0, "a+", "a-"), (1, "b+", "c+"), (1, "b+", "c+")], "vid long, start_seg string, end_seg string")
    links, segments = spark.createDataFrame([("a+", "b+")], "seg_a string, seg_b string"), spark.createDataFrame([("b+", 1)], "segment string, vid long")
    edges = graph.contig_edges(paths, links, segments)
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 0)]
    plan = edges._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = sum("Aggregate [src#" in line and "segment#" in line for line in plan)
    assert made == sum("Join Inner" in line and "seg_a#" in line for line in plan)  # of what met links alone


def test_far_queries_leave_out_rows_that_hardly_differ(monkeypatch):
    rng = np.random.default_rng(7)
    rows = np.hstack([rng.random((4000, 3)), np.ones((4000, 1))])
    asked = np.hstack([rng.random((50, 3)) / 20, rng.integers(5, 60, (50, 1)) + 0.5])
    exact, rough = neighbours.METRICS["euclid"]
    seen = []
    monkeypatch.setitem(neighbours.METRICS, "euclid", (lambda q, t: (seen.append(len(q)), exact(q, t))[1], rough))
    ids = np.arange(4000)
    for bound in (None, np.full(50, 60.0)):
        if bound is not None:
            bound = dist.reshape(50, 5)[:, -1] + neighbours.FINE  # noqa: F821
        at, to, dist = neighbours.block_nearest(asked, rows, ids, "euclid", 5, bound)
        every = np.round(np.sqrt(((asked[:, None] - rows[None]) ** 2).sum(2)), 9)
        assert to.reshape(50, 5).tolist() == [np.lexsort((ids, d))[:5].tolist() for d in every]
    assert max(seen) < 20 * 50  # of 4000 * 50


def test_groups_of_queries_are_as_many_as_the_cores_need(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "QUERY_NUMBERS", 10)
    rng = np.random.default_rng(8)
    x = rng.random((3000, 3)).tolist()
    train = spark.createDataFrame([(i, r, "plasmid") for i, r in enumerate(x)], "nbr long, x array<double>, label string")
    asked = spark.createDataFrame(list(enumerate(x)), "vid long, x array<double>")
    with scratch():
        index, placed = neighbours.CellIndex.of(train, "euclid", 5, 16, asked)
        groups = neighbours._bounded(asked, index, placed, "euclid", 5).select("g").distinct().count()
        assert groups <= 2 * neighbours.CORE_GROUPS * spark.sparkContext.defaultParallelism
        q = np.array(x[:50]) / 20 + [0, 0, 9]  # on another scale in the last component
        near = np.sort(np.sqrt(((q[:, None] - np.array(x)[None]) ** 2).sum(2)), 1)[:, 4]
        of, to, _ = index.reach(q, near + 1e-9)
        for p in range(len(index.cells)):
            own, cell = np.array(x)[index.cell_of(np.array(x)) == index.cells[p]], np.flatnonzero(to == p)
            lo, hi = index.within(q, near + 1e-9, p)
            far = np.sqrt(((q[:, None] - own[None]) ** 2).sum(2)) > near[:, None] + 1e-9
            assert far[:, (index.from_pivot(own) < lo) | (index.from_pivot(own) > hi)].all()
            assert far[np.setdiff1d(np.arange(50), of[cell])].all()


def _sides(spark, metric, n=2000):
    rng = np.random.default_rng(11)
    x = np.hstack([rng.random((n, 3)) / (20 if metric == "joint" else 1), rng.integers(5, 60, (n, 1)) / (1 if metric == "joint" else 55)])
    train = spark.createDataFrame([(i, r, "plasmid") for i, r in enumerate(x.tolist())], "nbr long, x array<double>, label string")
    return x, spark.createDataFrame(list(enumerate(x.tolist())), "vid long, x array<double>"), train


@pytest.mark.parametrize("metric", ["euclid", "joint"])
def test_rows_of_cells_that_no_query_of_a_group_may_reach_are_not_sent(spark, monkeypatch, metric):
    monkeypatch.setattr(neighbours, "QUERY_NUMBERS", 400)
    x, asked, train = _sides(spark, metric)
    with scratch():
        index, placed = neighbours.CellIndex.of(train, metric, 5, 64, asked)
        rows = neighbours._bounded(asked, index, placed, metric, 5).collect()
    exact = neighbours.METRICS[metric][0]
    cell, boxes, group = index.cell_of(x), {}, {r["vid"]: r["g"] for r in rows}
    for r in rows:
        if r["needs"] is not None:
            low, high = (np.array(r[c]).reshape(len(r["needs"]), -1) for c in ("low", "high"))
            for c, lo, hi in zip(r["needs"], low, high, strict=True):
                was = boxes.get((r["g"], c), (lo, hi))
                boxes[r["g"], c] = np.minimum(lo, was[0]), np.maximum(hi, was[1])
    sent, whole = {}, 0
    for (g, c), (lo, hi) in boxes.items():
        own = np.flatnonzero(cell == c)
        whole += len(own)
        sent.setdefault(g, set()).update(own[((x[own][:, index.wide] >= lo) & (x[own][:, index.wide] <= hi)).all(1)].tolist())
    assert sum(map(len, sent.values())) < 0.8 * whole
    for v in range(0, len(x), 40):
        d = np.round(exact(np.repeat(x[v : v + 1], len(x), 0), x), 9)
        assert set(np.lexsort((np.arange(len(x)), d))[:5].tolist()) <= sent[group[v]]


def test_queries_that_repeat_no_other_are_not_joined_and_repeats_get_the_same(spark, monkeypatch):
    x, asked, train = _sides(spark, "euclid", 300)
    names = []
    monkeypatch.setattr(neighbours, "written", lambda df, name, own=neighbours.written: (names.append(name), own(df, name))[1])
    once = {(r["vid"], r["rank"]): r["nbr"] for r in neighbours.nearest(asked, train, "euclid", block=64).collect()}
    assert "same" not in names and "queries" not in names and len(once) == 1500
    twice = asked.unionByName(asked.filter("vid < 20").selectExpr("vid + 1000 AS vid", "x"))
    got = {(r["vid"], r["rank"]): r["nbr"] for r in neighbours.nearest(twice, train, "euclid", block=64).collect()}
    assert got == once | {(v + 1000, r): n for (v, r), n in once.items() if v < 20}


def test_neighbours_of_queries_on_another_scale_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, q = np.round(rng.random((1500, 4)), 1), np.hstack([rng.random((300, 3)) / 20, rng.integers(0, 60, (300, 1))])
    train = spark.createDataFrame([(i, r, "plasmid") for i, r in enumerate(rows.tolist())], "nbr long, x array<double>, label string")
    got = neighbours.nearest(spark.createDataFrame(list(enumerate(q.tolist())), "vid long, x array<double>"), train, "euclid", block=64)
    every = np.round(np.sqrt(((q[:, None] - rows[None]) ** 2).sum(2)), 9)
    want = {(i, r + 1): int(n) for i, d in enumerate(every) for r, n in enumerate(np.lexsort((np.arange(1500), d))[:5])}
    assert {(r["vid"], r["rank"]): r["nbr"] for r in got.collect()} == want


def test_links_are_read_once_for_both_directions_and_nulls_make_no_edge(spark):
    paths = spark.createDataFrame([(0, "a+", "a-"), (1, "b+", "c+"), (2, "d+", None), (None, "a+", "b+")], "vid long, start_seg string, end_seg string")
    links = spark.createDataFrame([("a+", "b+"), ("b+", "a+"), ("c+", "d+"), (None, "a+"), ("b+", None)], "seg_a string, seg_b string")
    segments = spark.createDataFrame([("b+", 1), ("d+", 2), ("a+", 0), ("a+", None), (None, 1)], "segment string, vid long")
    edges = graph.contig_edges(paths, links, segments)
    assert sorted(map(tuple, edges.collect())) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    assert "Union" not in edges._jdf.queryExecution().optimizedPlan().toString()


def test_the_whole_refinement_finds_components_once(spark, monkeypatch):
    found = []
    monkeypatch.setattr(components, "connected_components", lambda links, own=components.connected_components: (found.append(1), own(links))[1])
    kinds = ["plasmid", "chromosome", "unclassified"]
    rows = [(v, 2000 + v, 5.5 + v % 4, [float(v % 3), float(v % 2)], kinds[v * v % 7 % 3]) for v in range(40)]
    vertices = spark.createDataFrame(rows, "vid long, length long, coverage double, profile array<double>, label string")
    pairs = [(v, v + 1) for v in range(39) if v % 5 < 3] + [(v, v + 10) for v in range(0, 30, 7)]
    edges = spark.createDataFrame([e for a, b in pairs for e in ((a, b), (b, a))], "src long, dst long")
    got = {r["vid"]: r["label"] for r in refinement.refine_all(vertices, edges).collect()}
    assert len(found) == 1
    plain = refinement.correct_by_topology(vertices, edges)
    for stage in (refinement.correct_by_composition, refinement.correct_by_coverage):
        plain = stage(plain, edges)
    plain = topology.corrected(plain, refine.refine(plain, edges))
    assert {r["vid"]: r["label"] for r in plain.collect()} == got and len(got) == 40


def test_components_are_solved_in_one_pass_and_rest_when_their_state_repeats(spark, monkeypatch):
    from pyspark.sql.pandas.group_ops import PandasGroupedOpsMixin

    rng = random.Random(4)
    pairs = [(a, a + 1) for a in range(0, 12)] + [(100, 101 + i) for i in range(3 * propagation.NEAR)] + [(200 + rng.randrange(9), 200 + rng.randrange(9)) for _ in range(14)] + [(300, 301)]
    edges, known = graph.undirected(spark.createDataFrame(pairs, "src long, dst long")), {0, 5, 11, 101, 102, 203, 300}
    labelled = spark.createDataFrame([(v,) for v in known], "vid long")
    passes, own = [], PandasGroupedOpsMixin.applyInPandas
    monkeypatch.setattr(PandasGroupedOpsMixin, "applyInPandas", lambda *a: (passes.append(1), own(*a))[1])
    both = {tuple(r) for r in edges.collect()}
    for most, epsilon, times in ((700, 0.0, 1), (5, 0.0, 1), (300, 1.0, 2)):
        passes.clear()
        got = {(r["vid"], r["cls"]): r["p"] for r in propagation.propagate(edges, labelled, epsilon, most).collect()}
        assert len(passes) == times
        ids = sorted({a for a, _ in both})
        w = np.array([[(a, b) in both for b in ids] for a in ids], float)
        w = (w / w.sum(1, keepdims=True)).astype(np.float32).astype(float)
        y, on = np.diag([float(v in known) for v in ids]), np.array([v in known for v in ids])
        for _ in range(most):
            new = w @ y
            new[on, on] = 1
            total = new.sum(1, keepdims=True)
            new = np.where(~on[:, None] & (total > 0), new / np.where(total > 0, total, 1), new)
            change, y = np.abs(new - y).sum(), new
            if change <= epsilon:
                break
        want = {(ids[i], ids[j]): y[i, j] for i, j in zip(*np.nonzero(y), strict=True)}
        assert got == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("kind", ["few", "all"])
def test_a_far_last_component_leaves_cells_to_the_others(kind):
    """Queries far off in the last component, as unscaled ones are: cells beyond what the others leave aren't compared, and none that is needed is lost."""
    rng = np.random.default_rng(11)
    low = rng.random((3000, 4)) * [0.9, 0.9, 0.9, 0.5]
    some = np.arange(3000, dtype=float)
    x = np.hstack([rng.random((400, 3)) / 20, (rng.integers(5, 60, (400, 1)) if kind == "few" else 60 * rng.random((400, 1)) + 2) + 0.5])
    lead, none = np.full(3, 0.02), np.zeros((3000, 3))
    ring = np.sqrt(((low[:, :3] + 0.05 - lead) ** 2).sum(1))
    index = neighbours.CellIndex("euclid", 5, np.zeros(1, int), np.zeros(1), np.array(low + 0.05), none, none, some.astype(int), some, some * 0, some * 0 + 1, low, low + 0.1, lead, ring * 0, ring + 1, np.arange(4))
    gap = np.maximum(np.maximum(low - x[:, None], x[:, None] - low - 0.1), 0)
    apart = np.sqrt((gap**2).sum(2))
    bound = np.partition(apart, 3, axis=1)[:, 3] + 1e-6
    compared, own = [], index._least
    index._least = lambda x, to: (compared.append(to.size), own(x, to))[1]
    at, to, _ = index.reach(x, bound)
    assert compared[0] < 300
    index._least = own
    every = index._least(x, np.arange(3000)[None])
    assert set(zip(at.tolist(), to.tolist(), strict=True)) == set(map(tuple, np.argwhere(every <= bound[:, None]).tolist()))


def test_tables_of_distances_equal_their_formulas():
    rng = np.random.default_rng(13)
    k, mu = rng.integers(0, neighbours.KNOWN + 20, (2, 4000)) + 0.5
    assert np.array_equal(neighbours._coverage(k, mu), neighbours._poisson(np.trunc(k), np.trunc(mu)))
    assert np.array_equal(neighbours._coverage(k % 99, mu % 99), neighbours._poisson(np.trunc(k % 99), np.trunc(mu % 99)))
    for most in (0.07, 0.99, 3):
        d = most * rng.random((300, 100))
        assert np.abs(neighbours._rough_composition(d) - neighbours._smooth_composition(d)).max() < neighbours.ROUGH / 10

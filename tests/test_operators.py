"""The operators against hand-made and NumPy answers."""

import math
import random
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.functions import distances as d
from sparkweave.functions import sequences as q
from sparkweave.operators import evaluate, frontier, kmers, neighbours, propagation, refine, thresholds, topology
from sparkweave.operators.components import connected_components
from sparkweave.operators.graph import undirected
from sparkweave.sources.assembly import records_of

P, C, U = "plasmid", "chromosome", "unclassified"


def graph(spark, pairs):
    return undirected(spark.createDataFrame(pairs, "src long, dst long"))


def labels(spark, given):
    return spark.createDataFrame(list(given.items()), "vid long, label string")


def test_canonical_kmers():
    assert [len(q.canonical_kmers(k)) for k in (3, 4, 5)] == [32, 136, 512]


def test_kmer_counts_match_a_loop(spark):
    rng = random.Random(3)
    seqs = {i: "".join(rng.choice("ACGTN") for _ in range(n)) for i, n in enumerate([0, 3, 4, 9, 50, 101])}
    want = {}
    for i, s in seqs.items():
        s = s.replace("N", "A")
        for k in (s[j : j + 4] for j in range(len(s) - 3)):
            k = min(k, k[::-1].translate(str.maketrans("ACGT", "TGCA")))
            want[i, k] = want.get((i, k), 0) + 1
    got = kmers.kmer_counts(spark.createDataFrame(list(seqs.items()), "vid long, seq string"))
    assert {(r["vid"], r["kmer"]): r["n"] for r in got.collect()} == want
    dense = kmers.profiles(spark.createDataFrame(list(seqs.items()), "vid long, seq string"), least=50).collect()
    assert {r["vid"] for r in dense} == {4, 5} and all(abs(sum(r["profile"]) - 1) < 1e-9 and len(r["profile"]) == 136 for r in dense)


def test_kmers_stay_where_their_sequence_is(spark, monkeypatch):
    rng = random.Random(4)
    seqs = [(i, "".join(rng.choice("ACGTé") for _ in range(n))) for i, n in enumerate([0, 7, 300, 1000])] + [(9, None)]
    df = spark.createDataFrame(seqs, "vid long, seq string")
    plan = kmers.kmer_shares(kmers.kmer_counts(df))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Aggregate" not in plan
    turn = str.maketrans("ACGT", "TGCA")
    for k in (3, 11):  # in a dense array, and sorted
        want = {}
        for i, s in seqs:
            s = (s or "").replace("é", "A")
            for x in (s[j : j + k] for j in range(len(s) - k + 1)):
                x = min(x, x.translate(turn)[::-1])
                want[i, x] = want.get((i, x), 0) + 1
        for piece in (1 << 20, 13):
            monkeypatch.setattr(kmers, "PIECE", piece)
            got = [kmers.code_counts(s or "", k) for _, s in seqs]
            assert {(i, n): int(c) for (i, _), (code, count) in zip(seqs, got, strict=True) for n, c in zip(kmers._names(code, k).to_pylist(), count, strict=True)} == want
        assert {(r["vid"], r["kmer"]): r["n"] for r in kmers.kmer_counts(df, k).collect()} == want


def test_pieces_of_a_sequence_add_up(spark):
    rng = random.Random(5)
    s = "".join(rng.choice("ACGT") for _ in range(2000))
    cut = spark.createDataFrame([(1, s[i : i + 500 + 3]) for i in range(0, 2000, 500)], "vid long, seq string")
    whole = kmers.profiles(spark.createDataFrame([(1, s)], "vid long, seq string")).first()["profile"]
    got = kmers.merged(kmers.kmer_counts(cut))
    assert np.allclose(kmers.merged_profiles(got).first()["profile"], whole)


def test_codes(spark):
    got = spark.createDataFrame([("AAaN",), ("TGCA",)], "k string").select(q.kmer_code(F.col("k")).alias("c"), q.reverse_complement(F.col("k")).alias("r")).collect()
    assert [tuple(r) for r in got] == [(0, "NaTT"), (228, "TGCA")]


def test_thresholds(spark):
    ten = spark.createDataFrame([(x,) for x in (0.95, 0.9, 0.85, 0.8, 0.7, 0.6, 0.4, 0.3, 0.2, 0.1)], "prob double")
    assert thresholds.probability_thresholds(ten, "pc") == (0.95, 0.2) == thresholds.probability_thresholds(ten, "pf")
    got = ten.select(thresholds.assigned_class(F.col("prob"), 0.95, 0.2).alias("c")).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {C: 2, U: 8}
    with pytest.raises(ValueError):
        thresholds.probability_thresholds(ten.filter("prob <> 0.95"), "pc")


def test_kth_value_matches_a_sort(spark):
    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.25]) for _ in range(500)]
    df = spark.createDataFrame([(x,) for x in values], "prob double")
    for k in (1, 77, 250, 500):
        assert thresholds.kth_value(df, "prob", k, min(values), max(values), True) == sorted(values, reverse=True)[k - 1]
        assert thresholds.kth_value(df, "prob", k, min(values), max(values), False) == sorted(values)[k - 1]


def test_composition_and_coverage(spark):
    xs = {0.0: 0.0092044, 0.01: 0.0914465, 0.012: 0.1998922, 0.02: 1.9889624, 0.05: 19.2811478, 0.21: d.INF, 1.5: d.INF}
    got = spark.createDataFrame([(x,) for x in xs], "x double").select("x", d.composition(F.col("x")).alias("y")).collect()
    assert all(r["y"] == pytest.approx(xs[r["x"]], abs=1e-6) for r in got)
    ks = {(0, 0): 0, (5, 0): d.INF, (0, 5): 2.1714725, (10, 10): 0.9027079, (50, 10): 18.8260197, (200, 10): 179.2398335, (500, 10): d.INF}
    got = spark.createDataFrame([(k + 0.5, m + 0.5) for k, m in ks], "k double, m double").select("k", "m", d.coverage(F.col("k"), F.col("m")).alias("y")).collect()
    assert all(r["y"] == pytest.approx(ks[int(r["k"]), int(r["m"])], abs=1e-6) for r in got)
    got = spark.range(400).select("id", d.log_factorial(F.col("id")).alias("y")).collect()
    assert all(r["y"] == pytest.approx(math.lgamma(r["id"] + 1), rel=1e-12, abs=1e-12) for r in got)


def solve(pairs, labelled, most=1000):
    """The propagation in NumPy, over the whole graph at once."""
    ids = sorted({x for p in pairs for x in p})
    a = np.zeros((len(ids), len(ids)))
    for x, y in pairs:
        a[ids.index(x), ids.index(y)] = a[ids.index(y), ids.index(x)] = 1
    t = (a / a.sum(1, keepdims=True)).astype("float32").astype(float)
    known = [ids.index(v) for v in labelled]
    y = np.zeros((len(ids), len(known)))
    y[known, range(len(known))] = 1
    for step in range(1, most + 1):
        new = t @ y
        for i in range(len(ids)):
            if i in known:
                new[i, known.index(i)] = 1
            elif new[i].sum() > 0:
                new[i] /= new[i].sum()
        change, y = np.abs(new - y).sum(), new
        if change <= 1e-5:
            break
    return {(ids[i], labelled[j]): y[i, j] for i in range(len(ids)) for j in range(len(known)) if y[i, j] > 0}, step


@pytest.mark.parametrize(
    ("pairs", "labelled", "steps", "want"),
    [
        ([(0, 2), (2, 1)], [0, 1], 3, {(2, 0): 0.5, (2, 1): 0.5}),
        ([(0, 2), (2, 3), (3, 1)], [0, 1], 45, {(2, 0): 0.585787, (2, 1): 0.414213}),
        ([(0, 1), (0, 3), (1, 3), (2, 3)], [0, 1, 2], 30, {(3, 0): 0.362543, (3, 1): 0.362543, (3, 2): 0.274914}),
    ],
)
def test_propagation_goldens(spark, pairs, labelled, steps, want):
    truth, took = solve(pairs, labelled)
    assert took == steps
    got = {(r["vid"], r["cls"]): r["p"] for r in propagation.propagate(graph(spark, pairs), labels(spark, {v: P for v in labelled})).collect()}
    assert set(got) == set(truth) and all(got[k] == pytest.approx(truth[k], abs=1e-9) for k in truth)
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())


def test_propagation_of_several_components_and_by_joins(spark):
    pairs, labelled = [(0, 1), (1, 2), (10, 11), (11, 12), (12, 13), (13, 10), (20, 21)], [0, 10, 12]
    truth, _ = solve(pairs, labelled)
    for largest in (3000, 2):
        got = propagation.propagate(graph(spark, pairs), labels(spark, {v: P for v in labelled}), largest=largest, **({} if largest > 2 else {"epsilon": 1e-2}))
        got = {(r["vid"], r["cls"]): r["p"] for r in got.collect()}
        assert set(got) == set(truth) and all(got[k] == pytest.approx(truth[k], abs=1e-9 if largest > 2 else 0.05) for k in truth)
    assert propagation.propagate(graph(spark, [(1, 1)]), labels(spark, {1: P})).count() == 0


def test_weighted_propagation(spark):
    records = records_of(spark, [[1, 1, [[3, 1.0]]], [2, 2, [[3, 3.0]]], [3, 0, [[1, 1.0], [2, 3.0]]]])
    state = propagation.weighted_propagation(records, 1e-9, 20)
    got = {(r["vid"], r["label"]): r["score"] for r in state.collect()}
    assert got == {(1, 1): 1.0, (2, 2): 1.0, (3, 1): pytest.approx(0.25), (3, 2): pytest.approx(0.75)}
    best = propagation.best_labels(records, state)
    assert {r["vid"]: r["label"] for r in best.collect()} == {1: 1, 2: 2, 3: 2}
    assert {r["vid"]: r["score"] for r in propagation.clean_scores(state, best).collect()} == {1: 1.0, 2: 1.0, 3: pytest.approx(1.0)}
    with pytest.raises(ValueError):
        propagation.record_edges(records_of(spark, [[1, 1, [[9, 1.0]]]]))


def test_components_match_union_find(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["v"]: r["c"] for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}


def test_votes(spark):
    near = spark.createDataFrame([(1, i, lab, float(i)) for i, lab in enumerate([P, C, P, C, P, C, C])] + [(2, 1, P, 1.0), (2, 2, C, 2.0)] + [(3, 5, C, 9.0)], "vid long, nbr long, label string, dist double")
    assert {r["vid"]: r["label"] for r in topology.vote(near).collect()} == {1: P, 2: U, 3: C}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    train = [(i, [float(x)], rng.choice([P, C]).item()) for i, x in enumerate(rng.integers(0, 60, 40))]
    open_ = [(100 + i, [float(x)]) for i, x in enumerate([0, 3, 10, 30, 59, 900])]
    t, o = spark.createDataFrame(train, "nbr long, x array<double>, label string"), spark.createDataFrame(open_, "vid long, x array<double>")

    def cov(k, mu):
        mass = math.exp(k * math.log(max(mu, 1)) - math.lgamma(k + 1) - mu)
        return (0.0 if k == mu else math.inf) if mu <= 0 else -math.log10(mass) if mass > 0 else math.inf

    for block in (2048, 7):
        near = neighbours.nearest(o, t, "coverage", block=block)
        got = {r["vid"]: r["label"] for r in neighbours.nearest_vote(o, near).collect()}
        for vid, x in open_:
            best = sorted((round(cov(int(x[0]), int(y[0])), 9), i, lab) for i, y, lab in train)
            best = [lab for dist, _, lab in best if dist < math.inf][:5]
            assert got[vid] == (max(dict.fromkeys(best), key=best.count) if best else U)
    scaled, _ = neighbours.min_max_scaled(spark.createDataFrame([(1, [2.0, 7.0], P), (2, [4.0, 7.0], C)], "nbr long, x array<double>, label string"))
    assert {r["nbr"]: r["x"] for r in scaled.collect()} == {1: [0.0, 0.0], 2: [1.0, 0.0]}
    with pytest.raises(ValueError):
        neighbours.knn_labels(o, t.limit(2), "coverage", exact_pairs=1)


def sequential(pairs, given):
    near = {v: sorted({b for a, b in pairs if a == v} | {a for a, b in pairs if b == v}) for v in given}
    lab, changed = dict(given), True
    while changed:
        changed = False
        for v in sorted(lab):
            if len(near[v]) > 1:
                c, p = (sum(lab[n] == x for n in near[v]) for x in (C, P))
                new = C if c > p else P if p > c else lab[v]
                changed |= new != lab[v]
                lab[v] = new
    for v in sorted(lab):
        if len(near[v]) == 1 and lab[near[v][0]] != U:
            lab[v] = lab[near[v][0]]
    return lab


@pytest.mark.parametrize("seed", range(3))
def test_refinement_matches_sequential_sweeps(spark, seed):
    rng = random.Random(seed)
    pairs = [(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(28)) if a != b]
    given = {v: rng.choice([P, C, U]) for v in range(26)}
    got = {r["vid"]: r["label"] for r in refine.refine(labels(spark, given), graph(spark, pairs)).collect()}
    assert got == sequential(pairs, given)


def test_refinement_goldens(spark):
    for pairs, given, want in [
        ([(0, 1), (1, 2), (2, 3), (3, 0)], [P, C, P, C], [C] * 4), ([(0, 1), (1, 2)], [P, C, P], [P] * 3),
        ([(0, 1)], [P, C], [C, C]), ([(0, 1)], [P, U], [P, P]),
    ]:
        got = refine.refine(labels(spark, dict(enumerate(given))), graph(spark, pairs)).orderBy("vid").collect()
        assert [r["label"] for r in got] == want


def test_evaluation(spark):
    rows = spark.createDataFrame([("Chromosome", C), (C, U), (P, P), (P, C), (U, P)], "truth string, predicted string")
    matrix = evaluate.confusion(rows)
    assert matrix.first().asDict() == {"cc": 1, "cp": 0, "cu": 1, "pc": 1, "pp": 1, "pu": 0}
    s = evaluate.scores(matrix).first().asDict()
    assert (s["macro_precision"], s["macro_recall"], s["f1"]) == (75.0, 33.33, 46.15)
    assert (s["plasmid_precision"], s["plasmid_recall"], s["chromosome_precision"], s["chromosome_recall"]) == (100.0, 50.0, 50.0, 50.0)
    assert "f1: 46.15" in evaluate.report(matrix.first().asDict(), s)
    assert evaluate.scores(evaluate.confusion(rows.limit(0))).first()["f1"] is None
    assert {r["label"]: r["n"] for r in evaluate.class_counts(rows.withColumnRenamed("predicted", "label")).collect()} == {C: 2, P: 2, U: 1}


def test_all_labels_of_small_graphs_end(spark):
    for given in product([P, C], repeat=3):
        got = refine.refine(labels(spark, dict(enumerate(given))), graph(spark, [(0, 1), (1, 2), (2, 0)])).collect()
        assert len({r["label"] for r in got}) == 1


def test_refinement_in_blocks_matches_sequential_sweeps(spark):
    """Blocks of few edges, and two vertices with more neighbours than a block has edges."""
    rng = random.Random(8)
    pairs = [(a, b) for a, b in ((rng.randrange(25), rng.randrange(25)) for _ in range(32)) if a != b]
    pairs += [(hub, v) for hub in (3, 17) for v in range(0, 25, 2)]
    pairs = list({(min(p), max(p)) for p in pairs})
    given = {v: rng.choice([P, C, U]) for v in range(26)}
    got = {r["vid"]: r["label"] for r in refine.refine(labels(spark, given), graph(spark, pairs), largest=3).collect()}
    assert got == sequential(pairs, given)


def test_changes_run_through_a_long_chain_block_by_block(spark):
    sign = {P: 1, C: -1, U: 0}
    n = 50_000
    given = {i: P if i % 2 == 0 else C for i in range(n)}
    chain = [(i, i + 1) for i in range(n - 1)]
    signs = lambda some: spark.createDataFrame([(v, sign[x]) for v, x in some.items()], "vid long, sign int")
    swept, rounds = frontier.sweep_blocks(signs(given), graph(spark, chain), 1000)
    done = sequential_fast(chain, given)
    assert rounds < 60 and all(r["sign"] == sign[done[r["vid"]]] for r in swept.collect() if 0 < r["vid"] < n - 1)
    # What the first block decides reaches the last one: all others wait for it.
    m = 400
    wave = {i: P if i % 2 else C for i in range(1, m)} | {0: P}
    short = [(i, i + 1) for i in range(m - 1)]
    swept, rounds = frontier.sweep_blocks(signs(wave), graph(spark, short), 25)
    done = sequential_fast(short, wave)
    assert rounds <= m // 25 + 6 and all(r["sign"] == sign[done[r["vid"]]] for r in swept.collect() if 0 < r["vid"] < m - 1)


def test_a_long_chain_and_a_star(spark):
    n = 50_000
    chain = [(i, i + 1) for i in range(n)]
    star = [(100_000, 100_001 + i) for i in range(n)]
    edges = graph(spark, chain + star)
    given = {0: P, 10: C, 100_000: P}
    state = {(r["vid"], r["cls"]): r["p"] for r in propagation.propagate(edges, labels(spark, given), most=30).collect()}
    assert state[5, 0] == pytest.approx(1 - state[5, 10]) and state[130_000, 100_000] == 1 and (45, 10) not in state and (40, 10) in state
    start = {i: P if i % 3 else C for i in range(n + 1)} | {100_000 + i: C if i else P for i in range(n + 1)}
    got = {r["vid"]: r["label"] for r in refine.refine(labels(spark, start), edges).collect()}
    assert got == sequential_fast(chain + star, start)


def sequential_fast(pairs, given):
    near = {v: [] for v in given}
    for a, b in pairs:
        near[a].append(b)
        near[b].append(a)
    lab, changed = dict(given), True
    while changed:
        changed = False
        for v in sorted(lab):
            if len(near[v]) > 1:
                p = sum((lab[n] == P) - (lab[n] == C) for n in near[v])
                new = P if p > 0 else C if p < 0 else lab[v]
                changed |= new != lab[v]
                lab[v] = new
    for v in sorted(lab):
        if len(near[v]) == 1 and lab[near[v][0]] != U:
            lab[v] = lab[near[v][0]]
    return lab


@pytest.mark.parametrize("metric", ["joint", "euclid"])
def test_neighbours_with_many_equal_rows_match_all_pairs(spark, metric):
    rng = np.random.default_rng(6)
    base = rng.random((12, 4)) / 30
    train = [(i, [*map(float, base[rng.integers(0, 12)]), float(rng.integers(5, 20))], rng.choice([P, C]).item()) for i in range(150)]
    open_ = [(1000 + i, [*map(float, base[i % 12] + (i % 3) / 300), float(8 + i % 9)]) for i in range(40)]
    t, o = spark.createDataFrame(train, "nbr long, x array<double>, label string"), spark.createDataFrame(open_, "vid long, x array<double>")
    for block in (2048, 11):
        got = {}
        for r in neighbours.nearest(o, t, metric, block=block).orderBy("vid", "rank").collect():
            got.setdefault(r["vid"], []).append((r["dist"], r["nbr"], r["label"]))
        for vid, x in open_:
            far = neighbours.METRICS[metric][0](np.array([x] * len(train)), np.array([y for _, y, _ in train]))
            best = sorted((round(dist, 9), i, lab) for dist, (i, _, lab) in zip(far.tolist(), train, strict=True) if math.isfinite(dist))[:5]
            assert [(i, lab) for _, i, lab in got.get(vid, [])] == [(i, lab) for _, i, lab in best]


def test_composition_switches_to_scaled_neighbours_of_queries_as_they_are(spark):
    """Beyond the limit of pairs the training rows are scaled, the queries aren't, and the plain majority of five decides."""
    from sparkweave.plans import refinement

    rng = np.random.default_rng(21)
    rows = [(i, int(rng.integers(900, 3000)), float(rng.integers(5, 40)), [*map(float, rng.random(4) / 20)], [P, C, U][i % 3]) for i in range(60)]
    v = spark.createDataFrame(rows, "vid long, length long, coverage double, profile array<double>, label string")
    edges = graph(spark, [(0, 1), (1, 2), (0, 3), (0, 4)])  # 0 has too many neighbours to teach
    got = {r["vid"]: r["label"] for r in refinement.correct_by_composition(v, edges, exact_pairs=1).collect()}
    train = [(i, np.array([*p, c]), lab) for i, n, c, p, lab in rows if lab != U and n >= 1000 and i != 0]
    lo, hi = (f([x for _, x, _ in train], axis=0) for f in (np.min, np.max))
    for i, n, c, p, lab in rows:
        if lab == U and n >= 1000:
            near = sorted((round(float(np.sqrt(((np.array([*p, c]) - (x - lo) / (hi - lo)) ** 2).sum())), 9), j, own) for j, x, own in train)[:5]
            votes = [own for _, _, own in near]
            assert got[i] == min(set(votes), key=lambda x: (-votes.count(x), x))
        else:
            assert got[i] == lab

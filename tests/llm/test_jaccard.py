import itertools
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest_llm import ODD, texts_of

from sparkweave.llm import jaccard as j


def plain_sets(rows, size):
    out = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    return out


def plain_components(rows, percent, size):
    """doc_id to (set size, least id reachable), by all pairs that share a shingle."""
    sets, up = plain_sets(rows, size), list(range(len(rows)))
    holds = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            holds[x].append(k)
    pairs = {p for ks in holds.values() for p in itertools.combinations(ks, 2)}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            up[root(a)] = root(b)
    least = defaultdict(lambda: 10**18)
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least[root(k)], i)
    return {i: (len(sets[k]), least[root(k)] if sets[k] else i) for k, (i, _) in enumerate(rows)}


def family(rng, n, words, edits, first):
    """A text and copies of it with so many random words replaced, at most."""
    base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
    out = []
    for k in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append((first + k, " ".join(w)))
    return out


@pytest.mark.parametrize(("percent", "size"), [(90, 3), (80, 5)])
def test_components_match_all_pairs(spark, docs_of, percent, size):
    rng = random.Random(percent)
    rows = [(i, t) for i, t, _ in texts_of()]
    rows += family(rng, 60, 150, 5, 10_000) + family(rng, 40, 40, 3, 20_000) + family(rng, 30, 400, 16, 30_000) + family(rng, 20, 9, 1, 40_000)
    passage = " ".join(f"p{k}" for k in range(60))
    rows += [(50_000 + k, f"{passage} " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randint(1, 60)))) for k in range(40)]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.link_components(docs_of(rows), percent, size).collect()}
    assert got == plain_components(rows, percent, size)


def test_odd_rows(spark, docs_of):
    df = docs_of([*[r for r in ODD if r[0] is not None], (9, "ONE two"), (10, "one\ttwo"), (11, "one"), (12, "same text here now")])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.link_components(df).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (1, 4)
    assert got[9] == got[10] == (1, 9) and got[11] == (1, 11) and got[5] == got[12] == (2, 5)
    assert j.link_components(df.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, docs_of):
    rng = random.Random(1)
    base = " ".join(f"w{k}" for k in range(100))
    df = docs_of([(3, base), (7, base + " more"), (5, base), (5, base), (9, " ".join(f"x{rng.random()}" for _ in range(50))), (1, None), (2, None), (None, base)])
    out = j.keep_one_of_each(df, 80, 5)
    assert out.columns == df.columns and sorted(str(r["doc_id"]) for r in out.collect()) == ["1", "2", "3", "9", "None"]
    again = j.keep_one_of_each(docs_of([(4, "a b c d e f"), (4, "a b c d e f")]), 80, 5)
    assert again.count() == 1


def test_prefixes_share_what_they_promise():
    """Any two linked sets share the lesser L of their two prefixes."""
    rng = np.random.default_rng(4)
    frequency = 2 ** rng.integers(0, 6, j.SKETCH)
    for _ in range(300):
        n = int(rng.integers(1, 120))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        for _ in range(int(rng.integers(0, 4))):
            b[rng.integers(0, len(b))] = rng.integers(0, 2**63)
        b = np.unique(b)
        if j.linked(len(np.intersect1d(a, b)), len(a), len(b)):
            (p, x), (q, y) = j.prefix(a, frequency), j.prefix(b, frequency)
            assert len(np.intersect1d(p, q)) >= min(x, y)
            need = min(x - j.least_overlap(len(a)), y - j.least_overlap(len(b))) + -(-90 * (len(a) + len(b)) // 190)
            assert len(np.intersect1d(p, q)) >= need


@pytest.mark.parametrize("bits", [None, 64])
def test_rows_go_by_id_without_moving_their_texts(spark, docs_of, bits):
    from sparkweave.llm.common import without

    df = docs_of([(k, f"text {k}") for k in range(400)] + [(None, "no id"), (3, "again")]).selectExpr("*", "'x' AS `a.b`")
    gone = spark.createDataFrame([(k,) for k in range(0, 400, 40)] + [(None,), (999,)], "doc_id long")
    out = without(df, gone, bits)
    assert out.columns == df.columns
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted([*(str(k) for k in range(400) if k % 40), "3", "None"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    words = df.selectExpr("CAST(doc_id AS STRING) AS doc_id", "text")
    assert without(words, words.filter("doc_id = '7'"), bits).count() == df.count() - 1 and without(words, words.limit(0)).count() == df.count()


def test_texts_that_differ_under_one_id(spark, docs_of):
    rng = random.Random(7)
    prose = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    a, b, c = prose(), prose(), prose()
    df = docs_of([(1, a), (5, a), (5, b), (5, b), (5, c + " end"), (7, c)]).selectExpr("*", "'x' AS `a.b`", "1 AS _class")
    out = j.keep_one_of_each(df, 80, 5)
    assert out.columns == df.columns and sorted((r["doc_id"], r["text"]) for r in out.collect()) == sorted([(1, a), (5, b), (5, c + " end")])


def test_frequent_shingles_are_dealt_by_class(spark, docs_of, monkeypatch):
    monkeypatch.setattr(j, "FREQUENT", 2)
    monkeypatch.setattr(j, "RANGE", 50)
    monkeypatch.setattr(j, "PACKED", 300)
    rng = random.Random(11)
    rows = family(rng, 60, 150, 5, 10_000) + family(rng, 40, 40, 3, 20_000) + [(i, t) for i, t, _ in texts_of()][:80]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.link_components(docs_of(rows), 80, 5).collect()}
    assert got == plain_components(rows, 80, 5)


def test_the_query_gives_the_rows_of_its_sql(spark):
    import duckdb

    sf, db = "/root/testdata/sf0.001", duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = j.op5_ngram_jaccard_join(spark, sf)
    assert sorted(got.columns) == ["component_id", "doc_id", "n_shingles"]
    want = sorted(db.execute(f"SELECT doc_id, n_shingles, component_id FROM ({j.OP5_SQL})").fetchall())
    assert sorted(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == want and any(c != i for i, _, c in want)

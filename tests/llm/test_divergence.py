import random
import re
from collections import Counter

import pytest
from conftest_llm import ODD, SF

from sparkweave.llm import divergence
from sparkweave.llm.divergence import audit_sources, first_of_ties, full_ranks, op11_source_divergence_audit, top_k

COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute(docs, least, top):
    """Every term of every group and pair; docs: (text, lang, source)."""
    low = {c: c + 32 for c in range(65, 91)}
    held, counts = {}, {}
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(low))
        held.setdefault(lang, Counter()).update(set(found))
        counts.setdefault((lang, source), Counter()).update(found)
    rows = []
    for lang, df in held.items():
        kept = [t for t, n in df.items() if n >= least]
        sources = [s for x, s in counts if x == lang]
        whole = Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def shares(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            own = [(apart(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", own, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                rows += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(rows)


@pytest.fixture
def sourced(spark):
    def make(rows):
        df = spark.createDataFrame(rows, "text string, lang string, source string")
        return df.selectExpr("*", "1 AS n", "'x' AS term", "2 AS `a.b`", "3 AS value", "4 AS item")

    return make


def test_equals_sums_over_all_terms(sourced):
    rng = random.Random(3)
    names = ["é", "É", "Zz", "ab", "a", "aé", "longer", "x" * 40, "x" * 39 + "y", "中文"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(rng.choices(names, k=rng.randrange(0, 40))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "é", "", None])) for _ in range(300)]
    rows += [(None, "en", "silent"), ("", "fr", "only"), ("rare", "it", "a"), ("rare", "it", "b"), *[("7 8 9", "nl", s) for s in "ab"]]
    rows += [("same words here " * 50, "en", "s1")] * 30
    got = sorted(map(tuple, audit_sources(sourced(rows), 3, 4).select(*COLUMNS).collect()))
    assert got == brute(rows, 3, 4)


def test_odd_texts_and_repeats(sourced):
    rows = [(t, "en", f"s{k % 3}") for k, (_, t) in enumerate(ODD * 4)]
    assert sorted(map(tuple, audit_sources(sourced(rows)).select(*COLUMNS).collect())) == brute(rows, 10, 10)


def test_empty_table(sourced):
    assert audit_sources(sourced([("a", "b", "c")]).limit(0)).count() == 0


def ranked(rows, k=None):
    groups = {}
    for g, item, value in rows:
        groups.setdefault(g, []).append((-value, item.encode(), item))
    return sorted((g, item, -v, r) for g, x in groups.items() for r, (v, _, item) in enumerate(sorted(x)[:k], 1))


def test_radix_selection_with_many_ties(spark, monkeypatch):
    monkeypatch.setattr(divergence.first_of_ties, "__defaults__", (3,))
    rng = random.Random(5)
    rows = [("one", f"{'p' * rng.randrange(6)}{i}", rng.choice([0, 0, 0, 5, 2**29])) for i in range(400)]
    rows += [("few", f"t{i}", i) for i in range(4)] + [("ties", "é" * (i % 7) + chr(300 + i), 9) for i in range(60)] + [("ties", "", 9), ("ties", "a\x00", 9), ("ties", "a", 9)]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    for k in (1, 7, 50):
        assert sorted(map(tuple, top_k(df, ["g"], k).select("g", "item", "value", "rank").collect())) == ranked(rows, k)


def test_first_of_ties_by_bytes(spark):
    items = ["", "a", "aa", "ab", "b", "é", "\U0001f600", "￿", "a" * 50, "a" * 50 + "b"] + ["a" * 50 + f"c{i}" for i in range(20)]
    tied = spark.createDataFrame([("g", x, 1, 8) for x in items], "g string, item string, value long, want int")
    got = {r["item"] for r in first_of_ties(tied, ["g"], few=2).collect()}
    assert got == set(sorted(items, key=str.encode)[:8])


def test_full_ranks(spark):
    rng = random.Random(6)
    rows = [(rng.choice("ab"), f"i{i}", rng.choice([0, 1, 1, 2**40 + i % 3, rng.randrange(2**33)])) for i in range(500)] + [("c", "z", 0), ("c", "y", 0)]
    df = spark.createDataFrame(rows, "g string, item string, value long")
    assert sorted(map(tuple, full_ranks(df, ["g"]).select("g", "item", "value", "rank").collect())) == ranked(rows)


def test_query_reads_all_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("text", "lang", "source").collect()]
    got = op11_source_divergence_audit(spark, SF)
    assert got.columns == COLUMNS and sorted(map(tuple, got.collect())) == brute(docs, 10, 10)

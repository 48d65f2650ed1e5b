import math

import duckdb
import numpy as np
from pyspark.sql import functions as F

from sparkweave.llm import topk as t


def plain(rows, k=5, every=50):
    """query_id, rank, vec_id, score by all pairs."""
    good = {(i, tuple(math.floor(256 * float(x)) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, v in good for qi, w in good if qi == q and i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS v", "2 AS score")
    rows = df.select("vec_id", t.quantised(F.col("embedding")).alias("v")).filter("v IS NOT NULL")
    got = t.top_k(rows, rows.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query_id"))
    return sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect())


def test_matches_all_pairs_with_ties_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 420)] + [(420, None), (421, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (422, [float("nan")] * 6), (423, [float("inf")] + [0.0] * 5), (424, [0.0] * 6)]
    rows += [rows[3], rows[3], (450, [0.5, -0.5]), (500, [3.0e5, -2.0e5, 0.0, 1.0, 2.0, 3.0])]
    assert run(spark, rows) == plain(rows)
    monkeypatch.setattr(t, "ROWS_PER_BLOCK", 60)
    monkeypatch.setattr(t, "QUERIES_PER_BLOCK", 3)
    assert run(spark, rows) == plain(rows)


def test_few_rows(spark):
    assert run(spark, []) == [] and run(spark, [(0, [1.0])]) == []
    assert run(spark, [(0, [1.0]), (3, [0.5])]) == [(0, 1, 3, 256 * 128)]


def test_bit_slices_sum_and_select():
    rng = np.random.default_rng(8)
    values = rng.integers(-300, 300, (500, 12))
    s = t.BitSlices(values)
    for _ in range(20):
        query = rng.integers(-255, 256, 12)
        total = s.weighted_sum(np.abs(query))
        u = (values >> t.QUANTUM_BITS) - s.base
        want = u @ np.abs(query)
        got = sum((np.unpackbits(b.view(np.uint8), bitorder="little")[:500].astype(np.int64) << i) for i, b in enumerate(total))
        assert (got == want).all()
        assert s.kth_largest(total, 5, s.all) == np.sort(want)[-5]
        assert set(s.places(s.at_least(total, int(np.sort(want)[-9]), s.all))) == set(np.flatnonzero(want >= np.sort(want)[-9]))
        exact = values @ query
        best = set(np.lexsort((np.arange(500), -exact))[:5].tolist())
        assert best <= set(s.top(query, 5, s.all).tolist())


def test_query_equals_sql(spark):
    sf = "/root/testdata/sf0.001"
    duckdb.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = sorted(duckdb.execute(t.OP6_SQL).fetchall())
    assert sorted(tuple(r) for r in t.op6_topk_search(spark, sf).collect()) == want


def test_huge_components_saturate(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1e300, 2.0]), (2, [-1e300, 0.0]), (3, [0.5, 0.5])], "vec_id long, embedding array<double>")
    rows = df.select("vec_id", t.quantised(F.col("embedding")).alias("v"))
    got = t.top_k(rows, rows.filter("vec_id = 0").withColumnRenamed("vec_id", "query_id")).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [1, 3, 2] and got[0]["score"] == 2**63 - 1 and got[2]["score"] == -(2**63 - 1)

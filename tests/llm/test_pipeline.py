"""The pipeline's stages on planted cases, and the registered queries."""

import random

import corpus_pipeline as cp
from conftest_llm import SF

from sparkweave.llm.queries import llm_queries, llm_sql

ITEM = "The quick surveyor measures the old bridge twice before the winter and writes the longer figure into the green book of the town"


def prose(rng, n):
    return " ".join("".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_stages(spark, docs_of, tmp_path):
    rng = random.Random(6)
    near = prose(rng, 200)
    rows = [(k, prose(rng, rng.randint(20, 300))) for k in range(30)]
    rows += [(100, near), (101, near), (102, near.replace(near.split()[50], "zebra", 1)), (103, "12345 678 !!"), (104, None), (105, f"{prose(rng, 40)} {ITEM} {prose(rng, 40)}"), (106, f"{prose(rng, 30)} write to jo@mail.example.com now")]
    df = docs_of(rows, clash=False)
    sf = tmp_path / "sf"
    df.write.parquet(str(sf / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(sf / "benchmark.parquet"))
    docs, seen = spark.read.parquet(str(sf / "documents.parquet")), []
    for k, (name, stage) in enumerate(cp.STAGES):
        stage(spark, docs, str(sf)).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        seen.append({r["doc_id"] for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == df.columns, name
    ids = {r[0] for r in rows}
    assert seen[0] == ids - {103, 104} and seen[1] == seen[0] - {101, 102} and seen[2] == seen[1] - {105} == seen[3] == seen[4]
    masked = spark.read.parquet(str(tmp_path / "3")).filter("doc_id = 106").first()["text"]
    assert "<EMAIL>" in masked and "@" not in masked
    direct = cp.run(spark, str(sf))
    assert sorted(map(tuple, direct.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, docs.select("doc_id", "piece", "ids_crc32").collect()))


def test_stages_take_odd_rows_names_and_empty_tables(spark, docs_of, tmp_path):
    """Columns with dots and with names that stages use, rows without id or text, an empty benchmark, and an empty table."""
    rng = random.Random(7)
    rows = [(k, prose(rng, 60)) for k in range(12)] + [(None, prose(rng, 30)), (None, None), (50, ""), (51, None), (0, prose(rng, 20)), (60, "mail jo@mail.example.com now " + prose(rng, 20))]
    named = docs_of(rows).selectExpr("*", "1 AS `a.b`", "2 AS `x y.z`", "3 AS column_5", "4 AS _shard")
    bench = spark.createDataFrame([], "item_id long, text string")
    for name, df in (("odd", named), ("empty", named.limit(0))):
        sf = tmp_path / name
        df.write.parquet(str(sf / "documents.parquet"))
        bench.write.parquet(str(sf / "benchmark.parquet"))
        docs = spark.read.parquet(str(sf / "documents.parquet"))
        for k, (_, stage) in enumerate(cp.STAGES[:-1]):
            stage(spark, docs, str(sf)).write.parquet(str(tmp_path / f"{name}-{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{name}-{k}"))
            assert docs.columns == df.columns
        got = cp.run(spark, str(sf)).select("doc_id").collect()
        assert {r[0] for r in got} == ({r[0] for r in rows} - {50, 51} if name == "odd" else set())
    kept = {r["doc_id"]: r for r in spark.read.parquet(str(tmp_path / "odd-3")).collect()}
    assert kept[60]["a.b"] == 1 and kept[60]["x y.z"] == 2 and kept[60]["column_5"] == 3 and "<EMAIL>" in kept[60]["text"]


def test_every_query_is_registered_and_runs(spark):
    names = set(llm_queries())
    assert {n.split("_")[0] for n in names} == {*(f"op{k}" for k in range(1, 14)), "pipeline"} and set(llm_sql()) <= names
    for name in ("op2_html_extraction", "op4_secret_scan", "op10_pii", "op7_decontamination"):
        assert llm_queries()[name](spark, SF).columns
    import duckdb

    for t in ("documents", "embeddings"):
        duckdb.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = llm_queries()["op1_sharding"](spark, SF).select("doc_id", "slot", "shard").collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.execute(f"SELECT doc_id, slot, shard FROM ({llm_sql()['op1_sharding']})").fetchall())

import pytest
from conftest_llm import ODD

from sparkweave.llm import sharding as s


def test_turns_give_even_shares_and_keep_owners():
    table = s.fill(32, 4099)
    shares = [table.count(i) for i in range(32)]
    assert max(shares) - min(shares) <= 1
    fewer = s.fill(31, 4099)
    moved = sum(a != b for a, b in zip(table, fewer, strict=True) if a != 31)
    assert moved < 0.25 * 4099
    with pytest.raises(ValueError):
        s.fill(4, 4100)


def test_table_unpacks(spark):
    assert [r["shard"] for r in s.lookup_table(spark, 5, 101).orderBy("slot").collect()] == s.fill(5, 101)


def test_rows_and_plan(spark, docs_of):
    df = docs_of(ODD)
    out = s.assign_shards(df, ["doc_id"])
    got = out.collect()
    assert len(got) == len(ODD) and all(0 <= r["shard"] < 32 and 0 <= r["slot"] < 4099 for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 5}) == 1
    assert s.assign_shards(df.limit(0), ["doc_id"]).count() == 0
    plan = out._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan and "ArrowEval" not in plan


def test_clashing_and_dotted_names(spark):
    df = spark.createDataFrame([(1, "a", "b", "c", 5), (2, "d", "e", None, 6)], "doc_id long, _slot string, _shard string, `a.b` string, slot int")
    out = s.assign_shards(df, ["doc_id", "a.b"])
    got = {r["doc_id"]: r for r in out.collect()}
    assert out.columns == ["doc_id", "_slot", "_shard", "a.b", "slot", "shard"]
    assert (got[1]["_slot"], got[1]["_shard"], got[1]["a.b"]) == ("a", "b", "c") and 0 <= got[2]["slot"] < 4099 and got[2]["a.b"] is None
    assert s.assign_shards(df, ["slot"]).filter("slot BETWEEN 0 AND 4098").count() == 2

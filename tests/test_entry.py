"""The registered queries against DuckDB on the smallest tables, and the whole plan on a small assembly."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sparkweave.plans.queries import core_queries, core_sql

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted((tuple(round(x, 6) if isinstance(x, float) and not math.isnan(x) else x for x in r) for r in rows), key=lambda r: [(x is None, "" if x is None else x) for x in r])


@pytest.mark.parametrize("name", sorted(core_sql()))
def test_query_equals_sql(spark, db, name):
    df = core_queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(cols)} FROM ({core_sql()[name]})").fetchall()
    assert plain(map(tuple, df.select(*cols).collect())) == plain(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("classifier", ["pf", "pc"])
def test_whole_plan(spark, tmp_path, classifier):
    import random

    from sparkweave.plans import refinement

    rng = random.Random(4)
    n = 24 if classifier == "pf" else 60  # of 30 likely plasmids three are above the threshold, or equal it
    seqs = ["".join(rng.choice("ACGT" if i % 2 else "AACT") for _ in range(1200)) for i in range(n)]
    names = [f"NODE_{i + 1}_length_1200_cov_{10 + 20 * (i % 2)}.5" for i in range(n)]
    (tmp_path / "contigs.fasta").write_text("".join(f">{x}\n{s[:600]}\n{s[600:]}\n" for x, s in zip(names, seqs, strict=True)))
    (tmp_path / "contigs.paths").write_text("".join(f"{x}\n{i}+\n{x}'\n{i}-\n" for i, x in enumerate(names)))
    (tmp_path / "graph.gfa").write_text("".join(f"L\t{i}\t+\t{i + 2}\t+\t0M\n" for i in range(n - 2)))
    probs = [(0.5 + i / 100 if i % 2 else 0.45 - i / 100) for i in range(n)]
    if classifier == "pc":
        (tmp_path / "p.tsv").write_text("".join(f"{x}\t{p}\n" for x, p in zip(names, probs, strict=True)))
    else:  # 24 columns of other figures, then those of two classes that add up
        lines = [["", *(f'"k{k}"' for k in range(1, 26))], *([str(i), f'"{i}"', f'"{x}"', *["0.9"] * 21, str(p / 4), str(3 * p / 4)] for i, (x, p) in enumerate(zip(names, probs, strict=True)))]
        (tmp_path / "p.tsv").write_text("".join("\t".join(x) + "\n" for x in lines))
    (tmp_path / "truth.tsv").write_text("".join(f"{x}\t{'plasmid' if i % 2 else 'chromosome'}\n" for i, x in enumerate(names)))
    got, edges = refinement.run(spark, *(str(tmp_path / x) for x in ("contigs.fasta", "contigs.paths", "graph.gfa")), classifier, str(tmp_path / "p.tsv"), str(tmp_path / "truth.tsv"))
    assert edges.count() == 2 * (n - 2)
    assert {r["vid"]: r["label"] for r in got.collect()} == {i: "plasmid" if i % 2 else "chromosome" for i in range(n)}

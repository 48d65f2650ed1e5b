"""Sequence files cut at any byte give the records that a plain reader gives."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkweave.operators import kmers
from sparkweave.plans import refinement
from sparkweave.sources import assembly, sinks
from sparkweave.sources.fasta import Cut, contigs_of_pieces, pieces, read_fasta_pieces


def make(rng, sizes, width):
    out = []
    for i, n in enumerate(sizes):
        s = "".join(rng.choice("ACGTN") for _ in range(n))
        lines = [s[j : j + width] for j in range(0, n, width)] if width else [s]
        out.append((f"NODE_{i + 1}_length_{n}_cov_{i}.5", f">NODE_{i + 1}_length_{n}_cov_{i}.5 remark {'x' * (i % 7)}\n" + "".join(x + "\n" for x in lines if x), s))
    return out


@pytest.mark.parametrize("width", [0, 7])
def test_every_cut_gives_every_base_once(tmp_path, width):
    rng = random.Random(width)
    records = make(rng, [40, 0, 3, 1, 25, 60], width)
    path = tmp_path / "c.fasta"
    path.write_text("".join(t for _, t, _ in records))
    size = path.stat().st_size
    for cut in (1, 2, 5, 13, 31, 64, size, size + 9):
        for piece in (4, 1000):
            got, header = {}, None
            with path.open("rb") as f:
                for lo in range(0, size, cut):
                    for _, _, _, _, own_header, seq, own in pieces(f, Cut("c", lo, min(lo + cut, size)), piece, 3):
                        header = own_header or header
                        got.setdefault(header, []).append((seq, own))
            assert list(got) == [h for h, _, _ in records]
            for h, _, s in records:
                at = 0
                for seq, own in got[h]:
                    assert seq == s[at : at + own + 3]
                    at += own
                assert at == len(s)


def test_long_records_in_several_tasks(spark, tmp_path):
    rng = random.Random(9)
    folder = tmp_path / "files"
    folder.mkdir()
    records = make(rng, [5000, 30, 12_000], 60)
    (folder / "a.fasta").write_text("".join(t for _, t, _ in records[:2]))
    (folder / "b.fasta").write_text(records[2][1])
    rows = read_fasta_pieces(spark, str(folder), cut=1500, piece=700)
    plain = assembly.read_fasta(spark, str(folder))
    assert rows.rdd.getNumPartitions() >= 1 and rows.filter("contig_id = 'NODE_3'").select("offset").distinct().count() > 8
    got = {tuple(r) for r in contigs_of_pieces(rows).select("contig_id", "header", "length", "coverage").collect()}
    assert got == {tuple(r) for r in plain.select("contig_id", "header", "length", "coverage").collect()}
    counts = kmers.merged(kmers.kmer_counts(rows.select("contig_id", "seq"), key="contig_id"), "contig_id")
    mine = {r["contig_id"]: r["profile"] for r in kmers.merged_profiles(counts, key="contig_id").collect()}
    want = {r["contig_id"]: r["profile"] for r in kmers.profiles(plain.select("contig_id", "seq"), key="contig_id", least=0).collect()}
    assert mine.keys() == want.keys() and all(np.allclose(mine[k], want[k]) for k in want)


def test_last_row_wins_over_several_files(spark, tmp_path):
    """Small splits, dealt to tasks by size, and files of different size."""
    folder = tmp_path / "truth"
    folder.mkdir()
    for name, label, n in (("a.tsv", "early", 900), ("b.tsv", "late", 40)):
        (folder / name).write_text("".join(f"NODE_{i % 30}_length_1_cov_1\t{label}{i}\n" for i in range(n)))
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
        spark.conf.set("spark.sql.files.openCostInBytes", "10")
        got = {r["contig_id"]: r["truth"] for r in assembly.read_truth(spark, str(folder)).collect()}
        assert spark.read.text(str(folder)).rdd.getNumPartitions() > 4
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == {f"NODE_{i % 30}": f"late{i}" for i in range(10, 40)}
    assert spark.range(3).select(F.col("id").alias("x")).transform(assembly.placed).columns == ["x", "_at"]


def test_the_plan_reads_either_way(spark, tmp_path):
    rng = random.Random(12)
    records = make(rng, [1500, 999, 2200, 1200], 70)
    again = records[0][1].replace("A", "C")  # the last of equal ids counts, for profiles the last that is long enough
    path = tmp_path / "c.fasta"
    path.write_text("".join(t for _, t, _ in records) + again + ">NODE_3_length_5_cov_2.5\nACGTA\n")
    tables = []
    for long_records in (False, True):
        contigs, profile = refinement.sequence_tables(spark, str(path), long_records)
        last = assembly.last_of_each(contigs).select("contig_id", "header", "length", "coverage").collect()
        tables.append((sorted(map(tuple, last)), {r["contig_id"]: np.round(r["profile"], 12).tolist() for r in profile.collect()}))
    assert tables[0] == tables[1] and len(tables[0][0]) == 4 and set(tables[0][1]) == {"NODE_1", "NODE_3", "NODE_4"}


def test_labels_in_one_file(spark, tmp_path):
    rows = spark.range(500).selectExpr("id AS vid", "concat('NODE_', id) AS contig_id", "'plasmid' AS label").repartition(7)
    sinks.write_labels(rows, str(tmp_path / "final"), True)
    assert (tmp_path / "final.txt").read_text() == "".join(f"NODE_{i}\tplasmid\n" for i in range(500))

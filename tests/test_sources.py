"""Readers on real files of the assembly formats."""

import pytest

from sparkweave.operators import graph
from sparkweave.sources import assembly, sinks


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "contigs.fasta").write_text(">NODE_1_length_8_cov_3.5\nACGT\nACGT\n>NODE_2_length_4_cov_2.25 more\nAANa\n")
    (tmp_path / "contigs.paths").write_text("NODE_1_length_8_cov_3.5\n1+\nNODE_1_length_8_cov_3.5'\n1-\nNODE_2_length_4_cov_2.25\n2+;\n3+\nNODE_2_length_4_cov_2.25'\n3-;\n2-\nNODE_3_length_4_cov_1.0\n4+\nNODE_3_length_4_cov_1.0'\n4-\n")
    (tmp_path / "g.gfa").write_text("S\t1\tACGT\nL\t1\t+\t2\t+\t55M\nL\tEDGE_3_length_4_cov_1\t+\tEDGE_4_length_9_cov_2\t-\t55M\n")
    return tmp_path


def test_fasta(spark, folder):
    got = rows(assembly.read_fasta(spark, str(folder / "contigs.fasta")), "contig_id", "seq", "length", "coverage")
    assert got == [("NODE_1", "ACGTACGT", 8, 3.5), ("NODE_2", "AANa", 4, 2.25)]


def test_paths_links_and_graph(spark, folder):
    paths, segments = assembly.read_contig_paths(spark, str(folder / "contigs.paths"))
    assert rows(paths, "vid", "contig_id", "start_seg", "end_seg") == [(0, "NODE_1", "1+", "1+"), (1, "NODE_2", "2+", "3+"), (2, "NODE_3", "4+", "4+")]
    links = assembly.read_links(spark, str(folder / "g.gfa"))
    assert rows(links, "seg_a", "seg_b") == [("1+", "2+"), ("2+", "1+"), ("3+", "4-"), ("4-", "3+")]
    edges = graph.contig_edges(paths, links, segments)
    assert rows(edges, "src", "dst") == [(0, 1), (1, 0), (1, 2), (2, 1)]
    lone = spark.createDataFrame([(0,), (1,), (2,), (7,)], "vid long")
    assert rows(graph.isolated(lone, edges), "vid") == [(7,)]
    assert rows(graph.degrees(lone, edges), "vid", "degree") == [(0, 1), (1, 2), (2, 1), (7, 0)]


def test_probabilities_keep_long_contigs_and_the_last_of_equals(spark, tmp_path):
    (tmp_path / "pc.tsv").write_text("NODE_1_length_2000_cov_1.0\t0.5\nNODE_2_length_999_cov_1.0\t0.9\nNODE_1_length_2000_cov_1.0\t0.75\n")
    assert rows(assembly.read_pc(spark, str(tmp_path / "pc.tsv")), "contig_id", "prob") == [("NODE_1", 0.75)]
    head = "\t".join(f'"h{i}"' for i in range(27))
    line = "\t".join(['"a"', '"b"', '"NODE_3_length_1000_cov_2.0"', *['"9"'] * 21, "0.25", "0.5", "0.125"])
    (tmp_path / "pf.tsv").write_text(f"{head}\n{line}\n")
    assert rows(assembly.read_pf(spark, str(tmp_path / "pf.tsv")), "contig_id", "prob") == [("NODE_3", 0.875)]
    (tmp_path / "truth.tsv").write_text("NODE_1_length_2000_cov_1.0\tplasmid\nNODE_2\tchromosome\nNODE_2\tplasmid\n")
    assert rows(assembly.read_truth(spark, str(tmp_path / "truth.tsv")), "contig_id", "truth") == [("NODE_1", "plasmid"), ("NODE_2", "plasmid")]


def test_records_and_checks(spark, tmp_path):
    lines = spark.createDataFrame([("[1, 0, [[2, 0.5], [3, 1]]]",), ("[2, 1, []]",)], "value string")
    got = {r["vid"]: (r["label"], [tuple(e) for e in r["edges"]]) for r in assembly.parse_records(lines).collect()}
    assert got == {1: (0, [(2, 0.5), (3, 1.0)]), 2: (1, [])}
    with pytest.raises(ValueError):
        assembly.check_inputs(spark, [str(tmp_path / "none")], "pc")
    with pytest.raises(ValueError):
        assembly.check_inputs(spark, [], "other")


def test_written_labels_are_in_order(spark, tmp_path):
    v = spark.createDataFrame([(2, "NODE_3", "plasmid"), (0, "NODE_1", "chromosome"), (1, "NODE_2", "unclassified")], "vid long, contig_id string, label string")
    sinks.write_labels(v, str(tmp_path / "final"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "final").glob("part-*")))
    assert text.splitlines() == ["NODE_1\tchromosome", "NODE_2\tunclassified", "NODE_3\tplasmid"]
    assert {r["label"]: r["colour"] for r in sinks.plot_nodes(v).collect()} == {"plasmid": "green", "chromosome": "orange", "unclassified": "white"}


def test_short_tables_last_records_and_logs(spark, tmp_path):
    import logging

    (tmp_path / "pf.tsv").write_text("a\tb\nx\t0.5\n")
    with pytest.raises(ValueError, match="24"):
        assembly.read_pf(spark, str(tmp_path / "pf.tsv"))
    (tmp_path / "c.fasta").write_text(">NODE_1_length_4_cov_1.0\nACGTACGT\n>NODE_2_length_1_cov_7.0\nA\n>NODE_1_length_4_cov_9.0\nCC\n")
    got = assembly.last_of_each(assembly.placed(assembly.read_fasta(spark, str(tmp_path / "c.fasta"))))
    assert rows(got, "contig_id", "seq", "coverage") == [("NODE_1", "CC", 9.0), ("NODE_2", "A", 7.0)]
    sinks.log_to(str(tmp_path / "out"), str(tmp_path / "out" / "x.log"))
    logging.getLogger("sparkweave").debug("figures %d", 7)
    assert "DEBUG - figures 7" in (tmp_path / "out" / "x.log").read_text()
    for h in logging.getLogger("sparkweave").handlers[:]:
        logging.getLogger("sparkweave").removeHandler(h)
        h.close()
    v = spark.createDataFrame([(0, "plasmid"), (1, "unclassified"), (2, "chromosome")], "vid long, label string")
    assert sinks.counts(v, spark.createDataFrame([(0, 1)], "src long, dst long")).first().asDict() == {"vertices": 3, "labels": 2, "labelled": 2, "unlabelled": 1, "edges": 1}


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from sparkweave import storage

    made = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None, set=lambda *_: None), sparkContext=SimpleNamespace(master=master))
    for master in ("yarn", "spark://x:7077", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError):
            storage.shared_dir(made(master))
    assert storage.shared_dir(made("local[4]"))

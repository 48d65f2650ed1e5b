"""The whole plan: assembly files and classifier probabilities to refined labels.

Run as `python -m sparkweave.plans.refinement -s FOLDER -c pc -f PROBABILITIES -o OUTPUT`."""

from __future__ import annotations

import argparse
import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.operators import evaluate, graph, kmers, neighbours, propagation, refine, thresholds, topology
from sparkweave.operators.components import named_components
from sparkweave.session import session
from sparkweave.sources import assembly, fasta, sinks
from sparkweave.storage import scratch, written

log = logging.getLogger("sparkweave")
LEAST_KNN, LEAST_SCORED = 1000, 500


def correct_by_topology(vertices: DataFrame, edges: DataFrame, components: DataFrame | None = None) -> DataFrame:
    """vertices (vid, length, coverage, profile, label) with labels voted by what each reaches."""
    state = propagation.propagate(edges, vertices.filter("label <> 'unclassified'"), components=components)
    return topology.corrected(vertices, topology.vote(topology.reachable(vertices, state)))


def training(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The vertices that teach: classified, long enough, and with fewer than three neighbours."""
    few = graph.degrees(vertices, edges).filter("degree < 3").select("vid")
    return vertices.filter((F.col("label") != "unclassified") & (F.col("length") >= LEAST_KNN)).join(few, "vid", "left_semi")


def correct_by_composition(vertices: DataFrame, edges: DataFrame, exact_pairs: int = neighbours.EXACT_PAIRS) -> DataFrame:
    x = F.concat("profile", F.array("coverage")).alias("x")
    train = training(vertices, edges).filter("profile IS NOT NULL").select(F.col("vid").alias("nbr"), x, "label")
    open_ = vertices.filter((F.col("label") == "unclassified") & (F.col("length") >= LEAST_KNN) & F.col("profile").isNotNull()).select("vid", x)
    return topology.corrected(vertices, neighbours.knn_labels(open_, train, "joint", exact_pairs))


def open_by_coverage(vertices: DataFrame, least: int = 500) -> DataFrame:
    """The unclassified vertices that coverage decides on: longer than least."""
    return vertices.filter((F.col("label") == "unclassified") & (F.col("length") > max(0, least)))


def correct_by_coverage(vertices: DataFrame, edges: DataFrame, least: int = 500, exact_pairs: int = neighbours.EXACT_PAIRS) -> DataFrame:
    x = F.array("coverage").alias("x")
    train = training(vertices, edges).select(F.col("vid").alias("nbr"), x, "label")
    open_ = open_by_coverage(vertices, least).select("vid", x)
    return topology.corrected(vertices, neighbours.knn_labels(open_, train, "coverage", exact_pairs))


def refine_all(vertices: DataFrame, edges: DataFrame, least: int = 500, watch=None) -> DataFrame:
    """All four corrections in turn, each written; watch gets a stage's name and its vertices.

    All of them read the vertices and edges several times, so that callers give written tables; components are found once."""
    stages = (
        ("topology", lambda v: correct_by_topology(v, edges, components)), ("composition", lambda v: correct_by_composition(v, edges)),
        ("coverage", lambda v: correct_by_coverage(v, edges, least)),
        ("refinement", lambda v: topology.corrected(v, refine.refine(v, edges, components=components))),
    )
    with scratch() as keep:
        components = named_components(edges)
        for name, stage in stages:
            vertices = (keep if name == stages[-1][0] else written)(stage(vertices), name)
            if watch:
                watch(name, vertices)
        return vertices


def sequence_tables(spark: SparkSession, path: str, long_records: bool = False) -> tuple[DataFrame, DataFrame]:
    """(contig_id, header, length, coverage, _at) of all records, and (contig_id, profile) of those that are long enough.

    Of equal ids the last counts, for profiles the last that is long enough. Long records are read in pieces, by several tasks each."""
    if not long_records:
        contigs = written(assembly.placed(assembly.read_fasta(spark, path)), "contigs")
        long = assembly.last_of_each(contigs.filter(F.col("length") >= kmers.LEAST_LENGTH))
        return contigs, kmers.profiles(long.select("contig_id", "seq"), key="contig_id")
    rows = fasta.read_fasta_pieces(spark, path).withColumn("_key", F.concat_ws("#", "file", "record"))
    contigs = written(fasta.contigs_of_pieces(rows), "contigs")
    long = assembly.last_of_each(contigs.filter(F.col("length") >= kmers.LEAST_LENGTH)).select("contig_id", F.concat_ws("#", "_at.file", "_at.record").alias("_key"))
    counts = kmers.merged(kmers.kmer_counts(rows, key="_key").join(long, "_key"), "contig_id")
    return contigs, kmers.merged_profiles(counts, key="contig_id")


def run(
    spark: SparkSession, sequences: str, paths: str, links: str, classifier: str, probabilities: str, truth: str | None = None, least: int = 500, long_records: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(vid, contig_id, label, ...) of every contig path, and the graph's edges."""
    assembly.check_inputs(spark, [sequences, paths, links, probabilities], classifier)
    contigs, profile = sequence_tables(spark, sequences, long_records)
    named, segments = assembly.read_contig_paths(spark, paths)
    total, long_ones = contigs.agg(F.count(F.lit(1)), F.count_if(F.col("length") >= kmers.LEAST_LENGTH)).first()
    log.debug("sequences %d, of these with %d characters or more %d", total, kmers.LEAST_LENGTH, long_ones)
    edges = written(graph.contig_edges(named, assembly.read_links(spark, links), segments), "contig-edges")
    probs = written({"pc": assembly.read_pc, "pf": assembly.read_pf}[classifier](spark, probabilities), "probabilities")
    plasmid, chromosome = thresholds.probability_thresholds(probs, classifier)
    log.debug("thresholds: plasmid above %s, chromosome up to %s", plasmid, chromosome)
    known = assembly.read_truth(spark, truth) if truth else None
    one = assembly.last_of_each(contigs).select("contig_id", "length", "coverage")
    vertices = graph.attach(named.select("vid", "contig_id"), one, probs, known, profile)
    vertices = written(vertices.withColumn("label", thresholds.assigned_class(F.col("prob"), plasmid, chromosome)), "vertices")
    if vertices.filter("length IS NULL").limit(1).count():
        raise ValueError("a contig path has no sequence")

    def watch(name: str, v: DataFrame) -> None:
        if truth:
            matrix = evaluate.confusion(v.filter(F.col("length") >= LEAST_SCORED).select("truth", F.col("label").alias("predicted")))
            log.info("after %s\n%s", name, evaluate.report(matrix.first().asDict(), evaluate.scores(matrix).first().asDict()))

    final = refine_all(vertices, edges, least, watch)
    log.debug("%s", sinks.described(edges, final))
    log.info("%s", ", ".join(f"{r['label']} {r['n']}" for r in evaluate.class_counts(final).collect()))
    return final, edges


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Refines labels of contigs with the assembly graph.")
    p.add_argument("-s", "--assembly", required=True, help="folder with contigs.fasta, contigs.paths and assembly_graph_with_scaffolds.gfa")
    p.add_argument("-c", "--classifier", required=True, type=str.lower, choices=["pc", "pf"])
    p.add_argument("-f", "--probabilities", required=True, help="the classifier's output")
    p.add_argument("-o", "--output", required=True, help="folder for the labels")
    p.add_argument("-t", "--threads", type=int, default=8)
    p.add_argument("-m", "--least-length", type=int, default=500)
    p.add_argument("-i", "--ground-truth", help="contig and label, separated by a tab, on each line")
    p.add_argument("--long-records", action="store_true", help="reads sequences in pieces, where a record is longer than a task should read")
    p.add_argument("--one-file", action="store_true", help="puts the labels in one file, final.txt")
    p.add_argument("--plots", action="store_true", help="writes tables of nodes and edges for plotting")
    p.add_argument("-v", "--version", action="version", version="sparkweave 0.1")
    got = p.parse_args(args)
    sinks.log_to(got.output, got.output + "/sparkweave.log")
    spark = session(f"local[{got.threads}]")
    names = (f"{got.assembly}/{x}" for x in ("contigs.fasta", "contigs.paths", "assembly_graph_with_scaffolds.gfa"))
    final, edges = run(spark, *names, got.classifier, got.probabilities, got.ground_truth, got.least_length, got.long_records)
    sinks.write_labels(final, f"{got.output}/final", got.one_file)
    if got.plots:
        sinks.plot_nodes(final).write.parquet(f"{got.output}/nodes")
        sinks.plot_edges(edges).write.parquet(f"{got.output}/edges")


if __name__ == "__main__":
    main()

"""Queries of the library's own operators on the test tables, each with SQL for the same rows.

Documents serve as sequences: their letters stand for bases. Orders serve as contigs of a graph: each has a path
of two segments, links join an order to the customer's next one, and urgent ones to the third after; line
quantities are its composition."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions import distances as d
from sparkweave.functions import sequences as q
from sparkweave.operators import evaluate, graph, kmers, neighbours, propagation, refine, thresholds, topology
from sparkweave.operators.components import connected_components
from sparkweave.plans import refinement
from sparkweave.sources import assembly, sinks
from sparkweave.storage import scratch, shared_dir, written

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# ---- documents as sequences

def headers(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    cov = (F.lit(5) + F.col("doc_id") * 37 % 60 + F.lit(0.5)).cast("string")
    return docs.select("doc_id", F.concat(F.lit("NODE_"), F.col("doc_id").cast("string"), F.lit("_length_"), F.col("n_chars").cast("string"), F.lit("_cov_"), cov).alias("header"))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("vid"), q.letters_as_bases(F.col("text")).alias("seq"))


def fasta_header_parse(spark: SparkSession, sf: str) -> DataFrame:
    h = F.col("header")
    return headers(spark, sf).select(q.contig_id(h).alias("contig_id"), q.header_length(h).alias("length"), q.header_coverage(h).alias("coverage"))


def fasta_records(spark: SparkSession, sf: str) -> DataFrame:
    """The documents' sequences as records of a file: a header, a remark, and the sequence on two lines."""
    named = headers(spark, sf).select(F.col("doc_id").alias("vid"), "header")
    rows = sequences(spark, sf).join(named, "vid")
    return rows.select(F.concat(F.lit(">"), "header", F.lit(" remark\n"), F.substring("seq", 1, 60), F.lit("\n"), F.expr("substring(seq, 61)")).alias("value"))


def fasta_counts(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.parse_fasta(fasta_records(spark, sf)).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("length") >= 1000).alias("long"))


def fasta_scan(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.parse_fasta(fasta_records(spark, sf)).select("contig_id", F.md5(F.col("seq").cast("binary")).alias("md5"), "length", "coverage")


def profiles_of_long(spark: SparkSession, sf: str) -> DataFrame:
    """The dense profiles of sequences of at least 1000, as (vid, pos, share) where the share isn't 0."""
    rows = kmers.profiles(sequences(spark, sf)).select("vid", F.posexplode("profile").alias("pos", "share"))
    return rows.filter("share > 0").select("vid", "pos", F.round("share", 9).alias("share"))


def path_records(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as path records, split at the common start of names: one of each strand, with a continued line."""
    key, cust = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    forward = F.concat(key, F.lit("_length_9_cov_1.5\ns"), cust, F.lit("+,m"), key, F.lit("-;\ne"), key, F.lit("-\n"))
    back = F.concat(key, F.lit("_length_9_cov_1.5'\ne"), key, F.lit("+;\nm"), key, F.lit("+,s"), cust, F.lit("-\n"))
    return table(spark, sf, "orders").select(F.explode(F.array(forward, back)).alias("value"))


def path_scan(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.parse_paths(path_records(spark, sf))[0]


def path_segments(spark: SparkSession, sf: str) -> DataFrame:
    return assembly.parse_paths(path_records(spark, sf))[1]


def record_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as lines of records: their nation is the label, and the account's balance the weight of two edges."""
    c = lambda name: F.col(name).cast("string")
    line = F.concat(F.lit("["), c("c_custkey"), F.lit(", "), c("c_nationkey"), F.lit(", [["), c("c_nationkey"), F.lit(", "), c("c_acctbal"), F.lit("], [7, 1]]]"))
    records = assembly.parse_records(table(spark, sf, "customer").select(line.alias("value")))
    return records.select("vid", "label", F.explode("edges").alias("e")).select("vid", "label", "e.dest", "e.weight")


def record_list(spark: SparkSession, sf: str) -> DataFrame:
    """The nations' records, handed over as a list: as many as there are nations, with edges that the sales make."""
    data = [[r["vid"], r["label"], [[e["dest"], e["weight"]] for e in r["edges"]]] for r in nation_records(spark, sf).collect()]
    return assembly.records_of(spark, data).select("vid", "label", F.explode("edges").alias("e")).select("vid", "label", "e.dest", "e.weight")


def input_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of sales ask for a file by their status and for a classifier by their flag: how many are refused for what they ask."""
    file = F.when(F.col("l_linestatus") == "O", "nation.parquet").otherwise("none.fasta")
    classifier = F.when(F.col("l_returnflag") == "A", "pc").when(F.col("l_returnflag") == "N", "pf").otherwise("px")
    asked = table(spark, sf, "lineitem").groupBy(file.alias("file"), classifier.alias("classifier")).agg(F.count(F.lit(1)).alias("n")).collect()  # six kinds at most

    def refused(file: str, classifier: str) -> bool:
        try:
            assembly.check_inputs(spark, [f"{sf}/{file}"], classifier)
        except ValueError:
            return True
        return False

    return spark.createDataFrame([(r["file"], r["classifier"], r["n"], refused(r["file"], r["classifier"])) for r in asked], "file string, classifier string, n long, refused boolean")


def written_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The label file of the orders, read again, and whether each line stands behind the one before it in its file."""
    path = f"{shared_dir(spark)}/sparkweave-final-{uuid.uuid4().hex}"
    named = order_vertices(spark, sf).select("vid", F.concat(F.lit("NODE_"), F.col("vid").cast("string")).alias("contig_id"), "label")
    with scratch() as keep:
        sinks.write_labels(named, path)
        lines = spark.read.schema("contig_id string, label string").option("sep", "\t").csv(path)
        placed = assembly.placed(lines.withColumn("_file", F.input_file_name())).withColumn("_vid", F.expr("cast(substring(contig_id, 6) AS bigint)"))
        return keep(placed.select("contig_id", "label", F.expr("coalesce(_vid > lag(_vid) OVER (PARTITION BY _file ORDER BY _at), true)").alias("ordered")), "labels")


def _hashed(key: Column) -> Column:
    return (key * 7919 % 1000) / F.lit(1000.0)


def read_pc(spark: SparkSession, sf: str) -> DataFrame:
    rows = headers(spark, sf).withColumn("_at", F.col("doc_id"))
    return assembly.parse_probabilities(rows, F.col("header"), _hashed(F.col("doc_id")))


def read_pf_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as tables of 64 columns."""
    columns = [F.get("embedding", F.lit(i)) for i in range(64)]
    return table(spark, sf, "embeddings").select(F.concat(F.lit("NODE_"), F.col("vec_id").cast("string")).alias("contig_id"), F.round(assembly.pf_probability(columns), 6).alias("prob"))


def contig_path_endpoints(spark: SparkSession, sf: str) -> DataFrame:
    body = F.regexp_replace(F.trim("text"), "[ \n]+", ",")
    first, last = assembly.path_ends(body)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("vid"), first.alias("start_seg"), last.alias("end_seg"))


def gfa_links(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select(F.concat(F.lit("L\tEDGE_"), F.col("l_partkey").cast("string"), F.lit("_length_9_cov_1\t+\tEDGE_"), F.col("l_suppkey").cast("string"), F.lit("_length_7_cov_2\t-\t0M")).alias("value"))
    other = table(spark, sf, "part").select(F.concat(F.lit("S\tEDGE_"), F.col("p_partkey").cast("string"), F.lit("\tACGT")).alias("value"))
    return assembly.parse_links(line.unionByName(other))


def kmer_profile(spark: SparkSession, sf: str) -> DataFrame:
    return kmers.kmer_shares(kmers.kmer_counts(sequences(spark, sf))).select("vid", "kmer", F.round("share", 9).alias("share"))


def kmer_code(spark: SparkSession, sf: str) -> DataFrame:
    counts = kmers.kmer_counts(sequences(spark, sf)).groupBy("kmer").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_docs"))
    return counts.select("kmer", q.kmer_code(F.col("kmer")).alias("code"), "n", "n_docs")


def revcomp(spark: SparkSession, sf: str) -> DataFrame:
    return sequences(spark, sf).select("vid", F.md5(q.reverse_complement(F.col("seq")).cast("binary")).alias("md5"))


SEQ_SQL = "seqs AS (SELECT doc_id AS vid, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents)"
KMER_SQL = SEQ_SQL + """, raw AS (SELECT vid, unnest(list_transform(range(1, length(seq) - 2), lambda i: substring(seq, i, 4))) AS km FROM seqs WHERE length(seq) >= 4),
counts AS (SELECT vid, least(km, reverse(translate(km, 'ACGT', 'TGCA'))) AS kmer, count(*) AS n FROM raw GROUP BY 1, 2)"""
HEADER_SQL = "h AS (SELECT doc_id, n_chars, 5 + (doc_id * 37 % 60) + 0.5::DOUBLE AS cov FROM documents)"


# ---- orders as contigs

def order_contigs(spark: SparkSession, sf: str) -> DataFrame:
    """(vid, cust, k, urgent, length, coverage, prob)"""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key.alias("vid"), F.col("o_custkey").alias("cust"), (F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.floor(F.col("o_totalprice") / 100).alias("length"),
        (F.lit(5) + key * 37 % 60 + F.lit(0.5)).alias("coverage"), _hashed(key).alias("prob"),
    )
    return rows.withColumn("k", F.expr("row_number() OVER (PARTITION BY cust ORDER BY vid)"))


def order_edges(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_contigs(spark, sf).select("vid", "cust", "k", "urgent")
    name = lambda k, end: F.concat(F.lit("c"), F.col("cust").cast("string"), F.lit("_"), k.cast("string"), F.lit(end))
    k = F.col("k")
    paths = rows.select("vid", name(k, "s+").alias("start_seg"), name(k, "e+").alias("end_seg"))
    segments = paths.select(F.explode(F.array("start_seg", "end_seg")).alias("segment"), "vid")
    links = rows.select(name(k, "e+").alias("seg_a"), name(k + 1, "s+").alias("seg_b")).unionByName(rows.filter("urgent").select(name(k, "e-").alias("seg_a"), name(k + 3, "s+").alias("seg_b")))
    return graph.contig_edges(paths, links, segments)


def order_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """(vid, profile): shares of the seven line numbers in the quantity, in twentieths."""
    qty = F.col("l_quantity")
    parts = [F.sum(F.when(F.col("l_linenumber") == i, qty).otherwise(0.0)) for i in range(1, 8)]
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("vid")).agg(F.array(*parts).alias("a"), F.sum("l_quantity").alias("s")).select("vid", F.transform("a", lambda x: x / F.col("s") / 20).alias("profile"))


def order_vertices(spark: SparkSession, sf: str) -> DataFrame:
    rows = order_contigs(spark, sf)
    plasmid, chromosome = thresholds.probability_thresholds(rows.select("prob"), "pc")
    rows = rows.withColumn("label", thresholds.assigned_class(F.col("prob"), plasmid, chromosome))
    return rows.select("vid", "length", "coverage", "label").join(order_profiles(spark, sf), "vid", "left")


def _thresholds(classifier: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        a, b = thresholds.probability_thresholds(order_contigs(spark, sf).select("prob"), classifier)
        return spark.range(1).select(F.lit(a).alias("plasmid"), F.lit(b).alias("chromosome"))

    return run


def assign_class(spark: SparkSession, sf: str) -> DataFrame:
    return order_vertices(spark, sf).select("vid", "label")


def degree(spark: SparkSession, sf: str) -> DataFrame:
    return graph.degrees(order_contigs(spark, sf), order_edges(spark, sf))


def isolated_vertices(spark: SparkSession, sf: str) -> DataFrame:
    return graph.isolated(order_contigs(spark, sf).select("vid"), order_edges(spark, sf))


def components(spark: SparkSession, sf: str) -> DataFrame:
    edges = order_edges(spark, sf)
    found = connected_components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")))
    rows = order_contigs(spark, sf).select("vid")
    return rows.join(found.withColumnRenamed("v", "vid"), "vid", "left").select("vid", F.coalesce("c", "vid").alias("component"))


def transition_weights(spark: SparkSession, sf: str) -> DataFrame:
    return propagation.transition_weights(order_edges(spark, sf)).select("src", "dst", F.round("w", 9).alias("w"))


def _state(spark: SparkSession, sf: str) -> DataFrame:
    return propagation.propagate_steps(order_edges(spark, sf), order_vertices(spark, sf).filter("label <> 'unclassified'"), 3)


def label_prop_steps_3(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf).select("vid", "cls", F.round("p", 6).alias("p"))


def label_prop_full(spark: SparkSession, sf: str) -> DataFrame:
    state = propagation.propagate(order_edges(spark, sf), order_vertices(spark, sf).filter("label <> 'unclassified'"))
    return state.select("vid", "cls", F.round("p", 6).alias("p"))


def topology_vote(spark: SparkSession, sf: str) -> DataFrame:
    v = order_vertices(spark, sf)
    return topology.corrected(v, topology.vote(topology.reachable(v, _state(spark, sf)))).select("vid", "label")


def nation_records(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as records: weight from customers' to suppliers' nations by quantity; the first twelve know their region."""
    sold = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("w"))
    from_ = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("l_orderkey"), F.col("c_nationkey").cast("long").alias("a"))
    to = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").cast("long").alias("b"))
    edges = sold.join(from_, "l_orderkey").join(to, "l_suppkey").groupBy("a", "b").agg(F.sum("w").alias("w")).filter("a <> b")
    out = edges.groupBy(F.col("a").alias("vid")).agg(F.collect_list(F.struct(F.col("b").alias("dest"), F.col("w").alias("weight"))).alias("edges"))
    label = F.when(F.col("n_nationkey") < 12, F.col("n_regionkey").cast("long") + 1).otherwise(F.lit(0))
    return table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("vid"), label.alias("label")).join(out, "vid", "left").select("vid", "label", F.coalesce("edges", F.array()).alias("edges"))


def labelprop_weighted_steps_3(spark: SparkSession, sf: str) -> DataFrame:
    _, state = _weighted_state(spark, sf)
    return state.select("vid", "label", F.round("score", 6).alias("score"))


def labelprop_weighted_full(spark: SparkSession, sf: str) -> DataFrame:
    records = nation_records(spark, sf)
    state = propagation.weighted_propagation(records, 1e-4, 100)
    return propagation.clean_scores(state, propagation.best_labels(records, state)).select("vid", "label", F.round("score", 6).alias("score"))


def _weighted_state(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    records = nation_records(spark, sf)
    shares, known = propagation.weighted_shares(records, propagation.record_edges(records)), propagation.weighted_start(records)
    state = known
    for _ in range(3):
        state = propagation.weighted_step(shares, state).unionByName(known)
    return records, state


def labelprop_best_labels(spark: SparkSession, sf: str) -> DataFrame:
    best = propagation.best_labels(*_weighted_state(spark, sf))
    return best.select("vid", "label", F.round("score", 6).alias("score"))


def labelprop_clean_scores(spark: SparkSession, sf: str) -> DataFrame:
    records, state = _weighted_state(spark, sf)
    return propagation.clean_scores(state, propagation.best_labels(records, state)).select("vid", "label", F.round("score", 6).alias("score"))


def propagation_change(spark: SparkSession, sf: str) -> DataFrame:
    """The sum of all changes of the third step."""
    edges, known = order_edges(spark, sf), order_vertices(spark, sf).filter("label <> 'unclassified'")
    return propagation.change_of_step(edges, known, 3).select(F.round("change", 5).alias("change"))


def read_truth_last_wins(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as contigs: each order states a truth, the last one counts."""
    rows = table(spark, sf, "orders").select(F.concat(F.lit("NODE_"), F.col("o_custkey").cast("string"), F.lit("_length_9_cov_1")).alias("h"), F.col("o_orderstatus").alias("truth"), F.col("o_orderkey").alias("_at"))
    return assembly.last_wins(rows.select(q.contig_id(F.col("h")).alias("contig_id"), "truth", "_at"), "contig_id")


def segment_flip(spark: SparkSession, sf: str) -> DataFrame:
    seg = F.concat(F.col("l_partkey").cast("string"), F.when(F.col("l_returnflag") == "R", "+").when(F.col("l_returnflag") == "A", "-").otherwise("?"))
    return table(spark, sf, "lineitem").select(seg.alias("segment")).distinct().select("segment", q.flipped(F.col("segment")).alias("flipped"))


def _edge_ends(spark: SparkSession, sf: str) -> DataFrame:
    v = order_contigs(spark, sf).select("vid", "coverage").join(order_profiles(spark, sf), "vid", "left")
    ends = lambda x: v.select(*[F.col(c).alias(c + x) for c in v.columns])
    return order_edges(spark, sf).join(ends("_a"), F.col("src") == F.col("vid_a")).join(ends("_b"), F.col("dst") == F.col("vid_b"))


def _finite(c: Column) -> Column:
    return F.when(c < d.INF, F.round(c, 6))


def coverage_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_ends(spark, sf).select("src", "dst", _finite(d.coverage(F.col("coverage_a"), F.col("coverage_b"))).alias("dist"))


def composition_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _edge_ends(spark, sf).select("src", "dst", _finite(d.composition(d.euclid(F.col("profile_a"), F.col("profile_b")))).alias("dist"))


def joint_distance(spark: SparkSession, sf: str) -> DataFrame:
    both = d.composition(d.euclid(F.col("profile_a"), F.col("profile_b"))) + d.coverage(F.col("coverage_a"), F.col("coverage_b"))
    return _edge_ends(spark, sf).select("src", "dst", _finite(both).alias("dist"))


def _knn_sides(spark: SparkSession, sf: str, x: Column) -> tuple[DataFrame, DataFrame]:
    """Both sides of a written table, as each is read several times."""
    v = written(order_vertices(spark, sf).filter("length >= 1000 AND profile IS NOT NULL").select("vid", x.alias("x"), "label"), "sides")
    return v.filter("label = 'unclassified'").select("vid", "x"), v.filter("label <> 'unclassified'").select(F.col("vid").alias("nbr"), "x", "label")


def _knn(x: Callable[[], Column], metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        with scratch() as keep:
            open_, train = _knn_sides(spark, sf, x())
            return keep(neighbours.nearest_vote(open_, neighbours.nearest(open_, train, metric)), "votes")

    return run


def knn_minmax_euclid(spark: SparkSession, sf: str) -> DataFrame:
    with scratch() as keep:
        open_, train = _knn_sides(spark, sf, F.concat("profile", F.array("coverage")))
        train, open_ = neighbours.min_max_scaled(train, open_)
        return keep(neighbours.library_vote(open_, neighbours.nearest(open_, train, "euclid")), "votes")


def refine_one_sync_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return refine.majority_sweep(order_vertices(spark, sf), order_edges(spark, sf))


def refine_full(spark: SparkSession, sf: str) -> DataFrame:
    return refine.refine(order_vertices(spark, sf), order_edges(spark, sf))


def leaf_copy(spark: SparkSession, sf: str) -> DataFrame:
    return refine.leaf_copy(order_vertices(spark, sf), order_edges(spark, sf))


def knn_training(spark: SparkSession, sf: str) -> DataFrame:
    return refinement.training(order_vertices(spark, sf), order_edges(spark, sf)).select("vid", "label")


def knn_open(spark: SparkSession, sf: str) -> DataFrame:
    return refinement.open_by_coverage(order_vertices(spark, sf), 700).select("vid")


def knn_switch(spark: SparkSession, sf: str) -> DataFrame:
    """More pairs than the exact metric takes: plain neighbours of scaled training rows and queries as they are."""
    open_, train = _knn_sides(spark, sf, F.concat("profile", F.array("coverage")))
    return neighbours.knn_labels(open_, train, "joint", exact_pairs=1000)


def attached(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with length and coverage, and with probability, truth and profile where there are any."""
    rows = order_contigs(spark, sf).withColumn("contig_id", F.concat(F.lit("NODE_"), F.col("vid").cast("string")))
    named = lambda df: df.withColumn("contig_id", F.concat(F.lit("NODE_"), F.col("vid").cast("string"))).drop("vid")
    truth = rows.filter("vid % 3 = 0").select("contig_id", F.when(F.col("urgent"), "plasmid").otherwise("chromosome").alias("truth"))
    profile = named(order_profiles(spark, sf).filter("vid % 5 <> 0"))
    out = graph.attach(rows.select("vid", "contig_id"), rows.select("contig_id", "length", "coverage"), rows.filter("vid % 2 = 0").select("contig_id", "prob"), truth, profile)
    return out.select("vid", "contig_id", "length", "coverage", "prob", "truth", F.size("profile").alias("parts"))


def graph_counts(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.counts(order_vertices(spark, sf), order_edges(spark, sf))


def _judged(spark: SparkSession, sf: str) -> DataFrame:
    truth = table(spark, sf, "orders").select(F.col("o_orderkey").alias("vid"), F.when(F.col("o_orderstatus") == "F", "Plasmid").when(F.col("o_orderstatus") == "O", "chromosome").otherwise("unclassified").alias("truth"))
    return order_vertices(spark, sf).filter("length >= 500").join(truth, "vid").select("truth", F.col("label").alias("predicted"))


def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(_judged(spark, sf))


def macro_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.scores(evaluate.confusion(_judged(spark, sf)))


def class_counts(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.class_counts(order_vertices(spark, sf))


def final_labels(spark: SparkSession, sf: str) -> DataFrame:
    with scratch() as keep:
        vertices, edges = written(order_vertices(spark, sf), "vertices"), written(order_edges(spark, sf), "edges")
        return keep(refinement.refine_all(vertices, edges).select("vid", "label"), "labels")


def plot_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.plot_nodes(order_vertices(spark, sf))


def plot_edges(spark: SparkSession, sf: str) -> DataFrame:
    return sinks.plot_edges(order_edges(spark, sf))


# ---- SQL for the same rows

ORDER_SQL = """o AS (SELECT o_orderkey AS vid, o_custkey AS cust, o_orderpriority = '1-URGENT' AS urgent, floor(o_totalprice / 100)::BIGINT AS length,
  5 + (o_orderkey * 37 % 60) + 0.5::DOUBLE AS coverage, (o_orderkey * 7919 % 1000) / 1000.0::DOUBLE AS prob,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders)"""
EDGE_SQL = ORDER_SQL + """, hop AS (SELECT a.vid AS s, b.vid AS d FROM o a JOIN o b ON a.cust = b.cust AND (b.k = a.k + 1 OR (a.urgent AND b.k = a.k + 3))),
edges AS (SELECT s AS src, d AS dst FROM hop UNION SELECT d, s FROM hop)"""


def _threshold_sql(up: float, down: float) -> str:
    return f"""n AS (SELECT count(*) FILTER (prob >= 0.5) AS a, count(*) FILTER (prob < 0.5) AS b FROM o),
hi AS (SELECT prob, row_number() OVER (ORDER BY prob DESC) AS r FROM o WHERE prob >= 0.5), lo AS (SELECT prob, row_number() OVER (ORDER BY prob) AS r FROM o WHERE prob < 0.5),
thr AS (SELECT (SELECT prob FROM hi, n WHERE r = round_even({up}::DOUBLE * a, 0)::BIGINT) AS plasmid, (SELECT prob FROM lo, n WHERE r = round_even({down}::DOUBLE * b, 0)::BIGINT) AS chromosome)"""


VERTEX_SQL = EDGE_SQL + ", " + _threshold_sql(0.1, 0.5) + """, prof AS (SELECT l_orderkey AS vid, list_transform([""" + ", ".join(f"sum(CASE WHEN l_linenumber = {i} THEN l_quantity ELSE 0 END)" for i in range(1, 8)) + """], lambda x: x / sum(l_quantity) / 20) AS profile FROM lineitem GROUP BY 1),
v AS (SELECT o.vid, length, coverage, CASE WHEN prob > plasmid THEN 'plasmid' WHEN prob <= chromosome THEN 'chromosome' ELSE 'unclassified' END AS label, profile
  FROM o CROSS JOIN thr LEFT JOIN prof ON o.vid = prof.vid)"""
DIST_SQL = """, ends AS (SELECT src, dst, a.coverage AS ca, b.coverage AS cb, a.profile AS pa, b.profile AS pb FROM edges JOIN v a ON a.vid = src JOIN v b ON b.vid = dst)"""


def _cov_sql(k: str, mu: str) -> str:
    k, mu = f"trunc({k})", f"trunc({mu})"
    mass = f"({k} * ln({mu}) - lgamma({k} + 1) - {mu})"
    return f"(CASE WHEN {mass} > -745 THEN -{mass} / ln(10) ELSE 'inf'::DOUBLE END)"


def _comp_sql(a: str, b: str) -> str:
    x = f"list_distance({a}, {b})"
    dens = lambda m, s: f"exp(-pow({x} - {m}, 2) / (2 * pow({s}, 2))) / {s}"
    same, other = dens("0::DOUBLE", "0.005189485::DOUBLE"), dens("0.0676654::DOUBLE", "0.03419337::DOUBLE")
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {same} > 0 AND ({same}) / ({same} + {other}) > 0 THEN -log10(({same}) / ({same} + {other})) ELSE 'inf'::DOUBLE END)"


def _steps_sql(steps: int) -> str:
    sql = """, deg AS (SELECT src, count(*) AS n FROM edges GROUP BY 1), t AS (SELECT edges.src, dst, (1.0::DOUBLE / n)::FLOAT::DOUBLE AS w FROM edges JOIN deg ON edges.src = deg.src),
s0 AS (SELECT vid, vid AS cls, 1.0::DOUBLE AS p FROM v WHERE label <> 'unclassified' AND vid IN (SELECT src FROM edges))"""
    for i in range(1, steps + 1):
        sql += f""", m{i} AS (SELECT t.src AS vid, s.cls, sum(t.w * s.p) AS p FROM t JOIN s{i - 1} s ON t.dst = s.vid GROUP BY 1, 2),
s{i} AS (SELECT vid, cls, p FROM m{i} WHERE vid IN (SELECT vid FROM s0) AND vid <> cls UNION ALL SELECT * FROM s0
  UNION ALL SELECT vid, cls, p / sum(p) OVER (PARTITION BY vid) FROM m{i} WHERE vid NOT IN (SELECT vid FROM s0))"""
    return sql


REACH_SQL = VERTEX_SQL + _steps_sql(3) + f""", near AS (SELECT u.vid, n.vid AS nbr, n.label, round(1 / p + coalesce(CASE WHEN u.length >= 1000 AND n.length >= 1000 THEN {_comp_sql("n.profile", "u.profile")} END, 0) + {_cov_sql("n.coverage", "u.coverage")}, 9) AS dist
  FROM s3 JOIN v u ON u.vid = s3.vid JOIN v n ON n.vid = s3.cls WHERE u.label = 'unclassified'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY dist, nbr) AS r FROM near),
votes AS (SELECT vid, min(label) AS lo, max(label) AS hi, count(*) FILTER (r <= 5 AND label = 'plasmid') AS p, count(*) FILTER (r <= 5 AND label <> 'plasmid') AS c FROM ranked GROUP BY 1)"""


def _knn_sql(dist: str, ties: str = "min(r)") -> str:
    return VERTEX_SQL + f""", x AS (SELECT vid, label, profile, coverage, list_append(profile, coverage) AS y FROM v WHERE length >= 1000 AND profile IS NOT NULL),
sc AS (SELECT i, min(y[i]) AS lo, max(y[i]) AS hi FROM x, range(1, 9) g(i) WHERE label <> 'unclassified' GROUP BY 1),
los AS (SELECT list(lo ORDER BY i) AS lo, list(hi ORDER BY i) AS hi FROM sc),
z AS (SELECT x.*, list_transform(range(1, 9), lambda i: coalesce((y[i] - lo[i]) / nullif(hi[i] - lo[i], 0), 0)) AS z FROM x, los),
pairs AS (SELECT a.vid, b.vid AS nbr, b.label, round({dist}, 9) AS dist FROM z a JOIN z b ON a.label = 'unclassified' AND b.label <> 'unclassified'),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY dist, nbr) AS r FROM pairs WHERE dist < 'inf'::DOUBLE) WHERE r <= 5),
cnt AS (SELECT vid, label, count(*) AS n, {ties} AS f FROM near GROUP BY 1, 2),
best AS (SELECT vid, label FROM (SELECT *, row_number() OVER (PARTITION BY vid ORDER BY n DESC, f) AS w FROM cnt) WHERE w = 1)
SELECT x.vid, coalesce(best.label, 'unclassified') AS label FROM x LEFT JOIN best ON x.vid = best.vid WHERE x.label = 'unclassified'"""


NATION_SQL = """rec AS (SELECT n_nationkey::BIGINT AS vid, CASE WHEN n_nationkey < 12 THEN n_regionkey + 1 ELSE 0 END::BIGINT AS label FROM nation),
ed AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, sum(l_quantity) AS w FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey GROUP BY 1, 2),
od AS (SELECT src AS vid, sum(w) AS deg FROM ed GROUP BY 1), w0 AS (SELECT vid, label, 1.0::DOUBLE AS score FROM rec WHERE label <> 0)"""
for _i in range(1, 4):
    NATION_SQL += f""", w{_i} AS (SELECT ed.dst AS vid, s.label, sum(s.score * (ed.w / od.deg)) AS score FROM ed JOIN w{_i - 1} s ON s.vid = ed.src JOIN rec ON rec.vid = ed.dst AND rec.label = 0 JOIN od ON od.vid = ed.dst GROUP BY 1, 2 UNION ALL SELECT * FROM w0)"""

#: All steps of the weighted form, numbered, and the first whose change is below the limit.
NATION_FULL_SQL = NATION_SQL + """, st AS (SELECT 0 AS i, vid, label, score FROM w0 UNION ALL (
  SELECT any_value(st.i) + 1, ed.dst, st.label, sum(st.score * (ed.w / od.deg)) FROM st JOIN ed ON st.vid = ed.src JOIN rec ON rec.vid = ed.dst AND rec.label = 0 JOIN od ON od.vid = ed.dst WHERE st.i < 100 GROUP BY ed.dst, st.label
  UNION ALL SELECT (SELECT max(i) FROM st) + 1, vid, label, score FROM w0 WHERE (SELECT max(i) FROM st) < 100)),
moved AS (SELECT coalesce(a.i, b.i + 1) AS i, sum(abs(coalesce(a.score, 0) - coalesce(b.score, 0))) AS change FROM st a FULL JOIN st b ON b.vid = a.vid AND b.label = a.label AND b.i = a.i - 1 GROUP BY 1),
fin AS (SELECT st.* FROM st WHERE i = (SELECT least(coalesce(min(i) FILTER (change < 1e-4), 100), 100) FROM moved WHERE i >= 1 AND i <= 100)),
top AS (SELECT vid, label, row_number() OVER (PARTITION BY vid ORDER BY score DESC, label) AS r FROM fin WHERE score > 0)"""
#: The same for the plain form; each step's rows say how much it changed, and the step after it needs more than the limit.
PROPAGATED_SQL = _steps_sql(0) + """, st AS (SELECT 0 AS i, vid, cls, p, 1.0::DOUBLE AS change FROM s0 UNION ALL (
  WITH m AS (SELECT t.src AS vid, st.cls, sum(t.w * st.p) AS p FROM t JOIN st ON t.dst = st.vid WHERE st.i < 1000 AND st.change > 1e-5 GROUP BY t.src, st.cls),
  new AS (SELECT vid, cls, p FROM m WHERE vid IN (SELECT vid FROM s0) AND vid <> cls UNION ALL SELECT vid, cls, p FROM s0 UNION ALL SELECT vid, cls, p / sum(p) OVER (PARTITION BY vid) FROM m WHERE vid NOT IN (SELECT vid FROM s0)),
  far AS (SELECT sum(abs(coalesce(new.p, 0) - coalesce(st.p, 0))) AS change FROM new FULL JOIN st ON st.vid = new.vid AND st.cls = new.cls)
  SELECT (SELECT max(i) FROM st) + 1, new.vid, new.cls, new.p, far.change FROM new, far WHERE (SELECT max(i) FROM st) < 1000 AND (SELECT max(st.change) FROM st) > 1e-5))"""
#: Sweeps in order of ids: all vertices are computed at once and again until none changes, then the next sweep begins.
SWEPT_SQL = """, st AS (SELECT 0 AS i, v.vid, CASE label WHEN 'plasmid' THEN 1 WHEN 'chromosome' THEN -1 ELSE 0 END AS old, CASE label WHEN 'plasmid' THEN 1 WHEN 'chromosome' THEN -1 ELSE 0 END AS new FROM v WHERE vid IN (SELECT src FROM edges) UNION ALL (
  WITH s AS (SELECT src AS vid, count(*) AS d, sum(CASE WHEN dst < src THEN st.new ELSE st.old END) AS s FROM edges JOIN st ON st.vid = dst GROUP BY 1),
  nx AS (SELECT st.i, st.vid, st.old, st.new, CASE WHEN d > 1 AND s <> 0 THEN sign(s)::INT ELSE st.old END AS nxt FROM st JOIN s ON s.vid = st.vid),
  f AS (SELECT coalesce(bool_or(nxt <> new), false) AS moved, coalesce(bool_or(nxt <> old), false) AS changed FROM nx)
  SELECT i + 1, vid, CASE WHEN moved THEN old ELSE nxt END, nxt FROM nx, f WHERE moved OR changed)),
swept AS (SELECT v.vid, CASE st.new WHEN 1 THEN 'plasmid' WHEN -1 THEN 'chromosome' WHEN 0 THEN 'unclassified' ELSE v.label END AS label FROM v LEFT JOIN st ON st.vid = v.vid AND st.i = (SELECT max(i) FROM st))"""

_FINITE = "CASE WHEN x < 'inf'::DOUBLE THEN round(x, 6) END AS dist"
LEAF_SQL = """, leaf AS (SELECT src AS vid, min(dst) AS dst FROM edges GROUP BY 1 HAVING count(*) = 1),
met AS (SELECT v.vid, v.label, leaf.dst, n.label AS near, (SELECT count(*) FROM leaf f WHERE f.vid = leaf.dst AND f.dst = v.vid) AS facing FROM v LEFT JOIN leaf ON leaf.vid = v.vid LEFT JOIN v n ON n.vid = leaf.dst)
SELECT vid, CASE WHEN dst IS NULL THEN label WHEN facing > 0 AND vid > dst AND label <> 'unclassified' THEN label WHEN near <> 'unclassified' THEN near ELSE label END AS label FROM met"""
SCORE_SQL = VERTEX_SQL + """, j AS (SELECT CASE o_orderstatus WHEN 'F' THEN 'plasmid' WHEN 'O' THEN 'chromosome' ELSE 'unclassified' END AS t, label AS p FROM v JOIN orders ON o_orderkey = vid WHERE length >= 500),
m AS (SELECT """ + ", ".join(f"count(*) FILTER (t = '{t}' AND p = '{p}') AS {t[0]}{p[0]}" for t in ("chromosome", "plasmid") for p in ("chromosome", "plasmid", "unclassified")) + " FROM j)"

QUERIES: dict[str, tuple[Query, str | None]] = {
    "kmer_profile": (kmer_profile, f"WITH {KMER_SQL} SELECT vid, kmer, round(n / sum(n) OVER (PARTITION BY vid), 9)::DOUBLE AS share FROM counts"),
    "kmer_code": (kmer_code, f"WITH {KMER_SQL} SELECT kmer, list_sum(list_transform(range(0, 4), lambda i: (strpos('ACGT', substring(kmer, i + 1, 1)) - 1) * (4 ** (3 - i))::BIGINT))::BIGINT AS code, sum(n)::BIGINT AS n, count(*) AS n_docs FROM counts GROUP BY kmer"),
    "revcomp": (revcomp, f"WITH {SEQ_SQL} SELECT vid, md5(reverse(translate(seq, 'ACGT', 'TGCA'))) AS md5 FROM seqs"),
    "fasta_header_parse": (fasta_header_parse, f"WITH {HEADER_SQL} SELECT 'NODE_' || doc_id AS contig_id, n_chars AS length, cov AS coverage FROM h"),
    "fasta_counts": (fasta_counts, f"WITH {SEQ_SQL} SELECT count(*) AS total, count(*) FILTER (length(seq) >= 1000) AS long FROM seqs"),
    "read_pc": (read_pc, "SELECT 'NODE_' || doc_id AS contig_id, (doc_id * 7919 % 1000) / 1000.0::DOUBLE AS prob FROM documents WHERE n_chars >= 1000"),
    "read_pf_sum": (read_pf_sum, "SELECT 'NODE_' || vec_id AS contig_id, round(list_sum(list_transform(embedding[25:], lambda x: x::DOUBLE)), 6) AS prob FROM embeddings"),
    "contig_path_endpoints": (contig_path_endpoints, r"WITH b AS (SELECT doc_id AS vid, string_split_regex(regexp_replace(trim(text), '[ \n]+', ',', 'g'), ',|;\n') AS s FROM documents) SELECT vid, s[1] AS start_seg, s[-1] AS end_seg FROM b"),
    "gfa_links": (gfa_links, "WITH l AS (SELECT l_partkey || '+' AS a, l_suppkey || '-' AS b FROM lineitem) SELECT a AS seg_a, b AS seg_b FROM l UNION SELECT b, a FROM l"),
    "prob_thresholds_pc": (_thresholds("pc"), f"WITH {ORDER_SQL}, {_threshold_sql(0.1, 0.5)} SELECT plasmid, chromosome FROM thr"),
    "prob_thresholds_pf": (_thresholds("pf"), f"WITH {ORDER_SQL}, {_threshold_sql(0.2, 0.5)} SELECT plasmid, chromosome FROM thr"),
    "assign_class": (assign_class, f"WITH {VERTEX_SQL} SELECT vid, label FROM v"),
    "contig_graph_edges": (order_edges, f"WITH {EDGE_SQL} SELECT src, dst FROM edges"),
    "degree": (degree, f"WITH {EDGE_SQL} SELECT o.vid, count(dst) AS degree FROM o LEFT JOIN edges ON o.vid = src GROUP BY 1"),
    "isolated_vertices": (isolated_vertices, f"WITH {EDGE_SQL} SELECT vid FROM o WHERE vid NOT IN (SELECT src FROM edges)"),
    "components": (components, f"WITH RECURSIVE {EDGE_SQL}, reach AS (SELECT vid, vid AS c FROM o UNION SELECT dst, c FROM reach JOIN edges ON src = reach.vid) SELECT vid, min(c) AS component FROM reach GROUP BY 1"),
    "transition_weights": (transition_weights, f"WITH {VERTEX_SQL}{_steps_sql(0)} SELECT src, dst, round(w, 9) AS w FROM t"),
    "label_prop_steps_3": (label_prop_steps_3, f"WITH {VERTEX_SQL}{_steps_sql(3)} SELECT vid, cls, round(p, 6) AS p FROM s3"),
    "label_prop_full": (label_prop_full, f"WITH RECURSIVE {VERTEX_SQL}{PROPAGATED_SQL} SELECT vid, cls, round(p, 6) AS p FROM st WHERE i = (SELECT max(i) FROM st) AND p > 0"),
    "fasta_scan": (fasta_scan, f"WITH {SEQ_SQL}, {HEADER_SQL} SELECT 'NODE_' || vid AS contig_id, md5(seq) AS md5, length(seq)::BIGINT AS length, cov AS coverage FROM seqs JOIN h ON doc_id = vid"),
    "profiles_of_long": (profiles_of_long, f"""WITH {KMER_SQL}, b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS c), k4 AS (SELECT p.c || q.c || r.c || s.c AS km FROM b p, b q, b r, b s),
names AS (SELECT kmer, row_number() OVER (ORDER BY kmer) - 1 AS pos FROM (SELECT DISTINCT least(km, reverse(translate(km, 'ACGT', 'TGCA'))) AS kmer FROM k4))
SELECT counts.vid, pos::INT AS pos, round(n / sum(n) OVER (PARTITION BY counts.vid), 9)::DOUBLE AS share FROM counts JOIN names USING (kmer) JOIN seqs ON seqs.vid = counts.vid WHERE length(seq) >= 1000"""),
    "path_scan": (path_scan, "SELECT o_orderkey - 1 AS vid, 'NODE_' || o_orderkey AS contig_id, 's' || o_custkey || '+' AS start_seg, 'e' || o_orderkey || '-' AS end_seg FROM orders"),
    "path_segments": (path_segments, "SELECT DISTINCT unnest(['s' || o_custkey || '+', 'e' || o_orderkey || '-', 'e' || o_orderkey || '+', 's' || o_custkey || '-']) AS segment, o_orderkey - 1 AS vid FROM orders"),
    "record_scan": (record_scan, "SELECT c_custkey AS vid, c_nationkey::BIGINT AS label, c_nationkey::BIGINT AS dest, c_acctbal AS weight FROM customer UNION ALL SELECT c_custkey, c_nationkey, 7, 1 FROM customer"),
    "record_list": (record_list, f"WITH {NATION_SQL} SELECT rec.vid, rec.label, ed.dst AS dest, ed.w AS weight FROM rec JOIN ed ON ed.src = rec.vid"),
    "input_checks": (input_checks, """WITH a AS (SELECT CASE l_linestatus WHEN 'O' THEN 'nation.parquet' ELSE 'none.fasta' END AS file, CASE l_returnflag WHEN 'A' THEN 'pc' WHEN 'N' THEN 'pf' ELSE 'px' END AS classifier FROM lineitem)
SELECT file, classifier, count(*) AS n, file = 'none.fasta' OR classifier = 'px' AS refused FROM a GROUP BY 1, 2"""),
    "written_labels": (written_labels, f"WITH {VERTEX_SQL} SELECT 'NODE_' || vid AS contig_id, label, true AS ordered FROM v"),
    "knn_training": (knn_training, f"WITH {VERTEX_SQL}, few AS (SELECT o.vid FROM o LEFT JOIN edges ON o.vid = src GROUP BY 1 HAVING count(dst) < 3) SELECT vid, label FROM v WHERE label <> 'unclassified' AND length >= 1000 AND vid IN (SELECT vid FROM few)"),
    "knn_open": (knn_open, f"WITH {VERTEX_SQL} SELECT vid FROM v WHERE label = 'unclassified' AND length > 700"),
    "knn_switch": (knn_switch, f"WITH {_knn_sql('list_distance(a.y, b.z)', 'label')}"),
    "attached": (attached, f"""WITH {VERTEX_SQL} SELECT o.vid, 'NODE_' || o.vid AS contig_id, o.length, o.coverage, CASE WHEN o.vid % 2 = 0 THEN prob END AS prob,
  CASE WHEN o.vid % 3 <> 0 THEN 'unclassified' WHEN urgent THEN 'plasmid' ELSE 'chromosome' END AS truth, CASE WHEN o.vid % 5 <> 0 AND prof.vid IS NOT NULL THEN 7 END AS parts FROM o LEFT JOIN prof ON prof.vid = o.vid"""),
    "graph_counts": (graph_counts, f"""WITH {VERTEX_SQL} SELECT count(*) AS vertices, count(DISTINCT label) FILTER (label <> 'unclassified') AS labels, count(*) FILTER (label <> 'unclassified') AS labelled,
  count(*) FILTER (label = 'unclassified') AS unlabelled, (SELECT count(*) FROM edges) AS edges FROM v"""),
    "labelprop_weighted_steps_3": (labelprop_weighted_steps_3, f"WITH {NATION_SQL} SELECT vid, label, round(score, 6) AS score FROM w3"),
    "labelprop_best_labels": (labelprop_best_labels, f"""WITH {NATION_SQL}, top AS (SELECT vid, label, score, row_number() OVER (PARTITION BY vid ORDER BY score DESC, label) AS r FROM w3 WHERE score > 0)
SELECT rec.vid, coalesce(top.label, (SELECT min(label) FROM rec WHERE label <> 0)) AS label, round(coalesce(score, 0), 6) AS score FROM rec LEFT JOIN top ON top.vid = rec.vid AND r = 1"""),
    "labelprop_clean_scores": (labelprop_clean_scores, f"""WITH {NATION_SQL}, top AS (SELECT vid, label, row_number() OVER (PARTITION BY vid ORDER BY score DESC, label) AS r FROM w3 WHERE score > 0)
SELECT w3.vid, any_value(top.label) AS label, round(sum(w3.score), 6) AS score FROM w3 JOIN top ON top.vid = w3.vid AND r = 1 GROUP BY 1 HAVING sum(w3.score) <> 0"""),
    "propagation_change": (propagation_change, f"WITH {VERTEX_SQL}{_steps_sql(3)} SELECT round(sum(abs(coalesce(s3.p, 0) - coalesce(s2.p, 0))), 5) AS change FROM s3 FULL JOIN s2 ON s3.vid = s2.vid AND s3.cls = s2.cls"),
    "read_truth_last_wins": (read_truth_last_wins, "SELECT 'NODE_' || o_custkey AS contig_id, arg_max(o_orderstatus, o_orderkey) AS truth FROM orders GROUP BY o_custkey"),
    "segment_flip": (segment_flip, "WITH s AS (SELECT DISTINCT l_partkey || CASE l_returnflag WHEN 'R' THEN '+' WHEN 'A' THEN '-' ELSE '?' END AS segment FROM lineitem) SELECT segment, substring(segment, 1, length(segment) - 1) || CASE WHEN segment LIKE '%+' THEN '-' ELSE '+' END AS flipped FROM s"),
    "labelprop_weighted_full": (labelprop_weighted_full, f"WITH RECURSIVE {NATION_FULL_SQL} SELECT fin.vid, any_value(top.label) AS label, round(sum(fin.score), 6) AS score FROM fin JOIN top ON top.vid = fin.vid AND r = 1 GROUP BY 1 HAVING sum(fin.score) <> 0"),
    "coverage_distance": (coverage_distance, f"WITH {VERTEX_SQL}{DIST_SQL}, y AS (SELECT src, dst, {_cov_sql('ca', 'cb')} AS x FROM ends) SELECT src, dst, {_FINITE} FROM y"),
    "composition_distance": (composition_distance, f"WITH {VERTEX_SQL}{DIST_SQL}, y AS (SELECT src, dst, {_comp_sql('pa', 'pb')} AS x FROM ends) SELECT src, dst, {_FINITE} FROM y"),
    "joint_distance": (joint_distance, f"WITH {VERTEX_SQL}{DIST_SQL}, y AS (SELECT src, dst, {_comp_sql('pa', 'pb')} + {_cov_sql('ca', 'cb')} AS x FROM ends) SELECT src, dst, {_FINITE} FROM y"),
    "topology_vote": (topology_vote, f"WITH {REACH_SQL} SELECT v.vid, coalesce(CASE WHEN lo = hi THEN lo WHEN p > c THEN 'plasmid' WHEN c > p THEN 'chromosome' WHEN lo IS NOT NULL THEN 'unclassified' END, v.label) AS label FROM v LEFT JOIN votes ON v.vid = votes.vid"),
    "knn_coverage": (_knn(lambda: F.array("coverage"), "coverage"), f"WITH {_knn_sql(_cov_sql('a.coverage', 'b.coverage'))}"),
    "knn_comp_cov": (_knn(lambda: F.concat("profile", F.array("coverage")), "joint"), f"WITH {_knn_sql(_comp_sql('a.profile', 'b.profile') + ' + ' + _cov_sql('a.coverage', 'b.coverage'))}"),
    "knn_minmax_euclid": (knn_minmax_euclid, f"WITH {_knn_sql('list_distance(a.z, b.z)', 'label')}"),
    "refine_one_sync_sweep": (refine_one_sync_sweep, f"WITH {VERTEX_SQL}, s AS (SELECT src, count(*) AS d, count(*) FILTER (label = 'chromosome') AS c, count(*) FILTER (label = 'plasmid') AS p FROM edges JOIN v ON vid = dst GROUP BY 1) SELECT vid, CASE WHEN d > 1 AND c > p THEN 'chromosome' WHEN d > 1 AND p > c THEN 'plasmid' ELSE label END AS label FROM v LEFT JOIN s ON src = vid"),
    "refine_full": (refine_full, f"WITH RECURSIVE {VERTEX_SQL}{SWEPT_SQL}{LEAF_SQL.replace('FROM v ', 'FROM swept v ').replace('JOIN v n', 'JOIN swept n')}"),
    "leaf_copy": (leaf_copy, f"WITH {VERTEX_SQL}{LEAF_SQL}"),
    "confusion_matrix": (confusion_matrix, f"WITH {SCORE_SQL} SELECT * FROM m"),
    "macro_scores": (macro_scores, f"""WITH {SCORE_SQL}, k AS (SELECT cc::DOUBLE / greatest(cc + pc, 1) AS pc_, pp::DOUBLE / greatest(pp + cp, 1) AS pp_, cc::DOUBLE / greatest(cc + cp + cu, 1) AS rc, pp::DOUBLE / greatest(pc + pp + pu, 1) AS rp,
  (cc + cp + pc > 0)::INT + (pp + pc + cp > 0)::INT AS np, (cc + cp + cu + pc > 0)::INT + (pp + pc + pu + cp > 0)::INT + (cu + pu > 0)::INT AS nr FROM m),
a AS (SELECT *, (pc_ + pp_) / nullif(np, 0) AS mp, (rc + rp) / nullif(nr, 0) AS mr FROM k)
SELECT round(100 * pc_, 2) AS chromosome_precision, round(100 * rc, 2) AS chromosome_recall, round(100 * pp_, 2) AS plasmid_precision, round(100 * rp, 2) AS plasmid_recall, round(100 * mp, 2) AS macro_precision, round(100 * mr, 2) AS macro_recall, round(100 * 2 * mp * mr / nullif(mp + mr, 0), 2) AS f1 FROM a"""),
    "class_counts": (class_counts, f"WITH {VERTEX_SQL} SELECT l.label, count(v.vid) AS n FROM (VALUES ('plasmid'), ('chromosome'), ('unclassified')) l(label) LEFT JOIN v ON v.label = l.label GROUP BY 1"),
    "final_labels": (final_labels, None),
    "plot_nodes": (plot_nodes, f"WITH {VERTEX_SQL} SELECT vid, label, CASE label WHEN 'plasmid' THEN 'green' WHEN 'chromosome' THEN 'orange' ELSE 'white' END AS colour FROM v"),
    "plot_edges": (plot_edges, f"WITH {EDGE_SQL} SELECT src, dst FROM edges WHERE src < dst"),
}


def core_queries() -> dict[str, Query]:
    return {k: run for k, (run, _) in QUERIES.items()}


def core_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in QUERIES.items() if sql}

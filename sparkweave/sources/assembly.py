"""Readers of assembly files and classifier outputs; parsing is separate from reading, so tables of lines serve as well."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkweave.functions.sequences import contig_id, header_coverage, header_length

LEAST_LENGTH = 1000
#: Fixed value: the first column, from 0, of the class probabilities that are added up.
FIRST_CLASS = 24


def parse_fasta(records: DataFrame) -> DataFrame:
    """(contig_id, header, seq, length, coverage) from records (value), one per sequence, with or without the leading sign."""
    v = F.regexp_replace("value", "^>", "")
    header = F.element_at(F.split(F.element_at(F.split(v, "\n", 2), 1), r"\s"), 1)
    body = F.regexp_replace(F.coalesce(F.get(F.split(v, "\n", 2), F.lit(1)), F.lit("")), r"\s", "")
    parts = records.select(header.alias("header"), body.alias("seq"))
    return parts.filter("header <> ''").select(contig_id(F.col("header")).alias("contig_id"), "header", "seq", F.length("seq").cast("long").alias("length"), header_coverage(F.col("header")).alias("coverage"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    return parse_fasta(spark.read.text(path, lineSep="\n>"))


def last_of_each(contigs: DataFrame) -> DataFrame:
    """contigs, with their place in the file as _at, but for all but the last record of each contig_id; sequences move only where ids repeat."""
    again = contigs.groupBy("contig_id").agg(F.count(F.lit(1)).alias("_n"), F.max("_at").alias("_last")).filter("_n > 1")
    if again.isEmpty():
        return contigs
    return contigs.join(again, "contig_id", "left").filter("_last IS NULL OR _at = _last").select(*contigs.columns)


def last_wins(rows: DataFrame, key: str) -> DataFrame:
    """Of rows with one key the last in the file, by the place that _at holds."""
    others = [c for c in rows.columns if c not in (key, "_at")]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*others), "_at").alias("_row"))
    return last.select(key, *[F.col(f"_row.{c}").alias(c) for c in others])


def placed(rows: DataFrame) -> DataFrame:
    """rows with _at, which follows the order of the lines: by file, block of the file, and line in the block.

    How blocks are packed into tasks plays no part. Rows that come from no file are in the order of their partitions."""
    line = F.monotonically_increasing_id()
    try:
        rows.select("_metadata.file_path")
    except AnalysisException:
        return rows.withColumn("_at", line)
    return rows.withColumn("_at", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), line.alias("line")))


def parse_probabilities(rows: DataFrame, header: Column, prob: Column) -> DataFrame:
    """(contig_id, prob) of contigs whose header says a length of at least 1000; the last of equal ids wins."""
    kept = rows.select(header.alias("h"), prob.cast("double").alias("prob"), "_at").filter(header_length(F.col("h")) >= LEAST_LENGTH)
    return last_wins(kept.select(contig_id(F.col("h")).alias("contig_id"), "prob", "_at"), "contig_id")


def read_pc(spark: SparkSession, path: str) -> DataFrame:
    """A table of two columns, contig and probability, without a header."""
    rows = placed(spark.read.schema("h string, p double").option("sep", "\t").csv(path))
    return parse_probabilities(rows, F.col("h"), F.col("p"))


def pf_probability(columns: list[Column], first: int = FIRST_CLASS) -> Column:
    """The sum of the columns from number `first`, from 0."""
    return F.aggregate(F.array(*[c.cast("double") for c in columns[first:]]), F.lit(0.0), lambda s, x: s + x)


def read_pf(spark: SparkSession, path: str) -> DataFrame:
    """A quoted table with a header: the id in column 2, class probabilities from column 24 on, both from 0."""
    rows = spark.read.option("sep", "\t").option("header", True).option("quote", '"').csv(path)
    if len(rows.columns) <= FIRST_CLASS:
        raise ValueError(f"a table of class probabilities has more than {FIRST_CLASS} columns, this one {len(rows.columns)}")
    rows = rows.toDF(*[f"c{k}" for k in range(len(rows.columns))])
    return parse_probabilities(placed(rows), F.col("c2"), pf_probability([F.col(c) for c in rows.columns]))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """(contig_id, truth); the last of equal ids wins."""
    rows = placed(spark.read.schema("h string, truth string").option("sep", "\t").csv(path))
    return last_wins(rows.select(contig_id(F.col("h")).alias("contig_id"), "truth", "_at"), "contig_id")


def path_ends(body: Column) -> tuple[Column, Column]:
    """First and last segment of a path; a semicolon at a line's end continues it."""
    parts = F.split(body, ",|;\n")
    return F.element_at(parts, 1), F.element_at(parts, -1)


def parse_paths(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """paths (vid, contig_id, start_seg, end_seg) and segments (segment, vid) from records (value) that begin after `NODE_`.

    The record of the reverse strand, whose name ends in ', gives segments alone."""
    name, body = F.element_at(F.split("value", "\n", 2), 1), F.regexp_replace(F.element_at(F.split("value", "\n", 2), 2), r"\n+$", "")
    start, end = path_ends(body)
    rows = placed(records.filter("value rlike '_length_'")).select((F.regexp_extract(name, "^(.*)_length_", 1).cast("long") - 1).alias("vid"), name.endswith("'").alias("back"), start.alias("s"), end.alias("e"), "_at")
    first = rows.filter("NOT back").groupBy("vid").agg(F.min_by(F.struct("s", "e"), "_at").alias("r"))
    paths = first.select("vid", F.concat(F.lit("NODE_"), (F.col("vid") + 1).cast("string")).alias("contig_id"), F.col("r.s").alias("start_seg"), F.col("r.e").alias("end_seg"))
    return paths, rows.select(F.explode(F.array("s", "e")).alias("segment"), "vid").distinct()


def read_contig_paths(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_paths(spark.read.text(path, lineSep="NODE_"))


def parse_links(lines: DataFrame) -> DataFrame:
    """(seg_a, seg_b), both ways and once, from the link lines among lines (value)."""
    f = F.split("value", "\t")
    bare = lambda c: F.regexp_replace(F.regexp_replace(c, "^EDGE_", ""), "_length.*", "")
    pairs = lines.filter(F.col("value").startswith("L\t")).select(F.concat(bare(F.get(f, F.lit(1))), F.get(f, F.lit(2))).alias("a"), F.concat(bare(F.get(f, F.lit(3))), F.get(f, F.lit(4))).alias("b"))
    return pairs.select(F.col("a").alias("seg_a"), F.col("b").alias("seg_b")).unionByName(pairs.select(F.col("b").alias("seg_a"), F.col("a").alias("seg_b"))).distinct()


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return parse_links(spark.read.text(path))


def parse_records(lines: DataFrame) -> DataFrame:
    """Propagation records (vid, label, edges) from lines `[vid, label, [[dest, weight], ...]]`."""
    v = F.from_json("value", "array<string>")
    edges = F.transform(F.from_json(F.get(v, F.lit(2)), "array<array<double>>"), lambda e: F.struct(F.get(e, F.lit(0)).cast("long").alias("dest"), F.get(e, F.lit(1)).alias("weight")))
    return lines.filter("trim(value) <> ''").select(F.get(v, F.lit(0)).cast("long").alias("vid"), F.get(v, F.lit(1)).cast("long").alias("label"), edges.alias("edges"))


def records_of(spark: SparkSession, data: list) -> DataFrame:
    """The same from Python lists."""
    rows = [(int(v), int(label), [(int(d), float(w)) for d, w in edges]) for v, label, edges in data]
    return spark.createDataFrame(rows, "vid long, label long, edges array<struct<dest: long, weight: double>>")


def check_inputs(spark: SparkSession, paths: list[str], classifier: str) -> None:
    """Raises unless every file is there and the classifier is known."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            raise ValueError(f"there is no file {path}")
    if classifier not in ("pf", "pc"):
        raise ValueError("the classifier is pf or pc")


__all__ = [
    "check_inputs", "last_of_each", "last_wins", "parse_fasta", "parse_links", "parse_paths", "parse_probabilities", "parse_records", "path_ends", "pf_probability", "placed",
    "read_contig_paths", "read_fasta", "read_links", "read_pc", "read_pf", "read_truth", "records_of",
]

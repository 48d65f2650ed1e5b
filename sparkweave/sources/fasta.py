"""A data source for sequence files whose records may be longer than a task should read.

Files are cut at byte offsets, also within a record. Each cut is read on its own: it gives pieces of sequence, and where a
piece's record began before the cut the piece doesn't know its header yet. Headers that each cut ends with are
then carried on, in order of the cuts, which moves one small row per cut. Pieces overlap their successor by as
many bases as a k-mer needs, so that each k-mer begins in one piece.

Files are opened by Arrow's file systems (local, HDFS, S3, GCS). Stores that only Spark can read take
`assembly.read_fasta`, where a record is one row. A header has at most LONGEST_HEADER bytes."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sparkweave.functions.sequences import contig_id, header_coverage

LONGEST_HEADER = 1 << 16
CHUNK = 1 << 20
SCHEMA = "file string, cut long, offset long, record long, header string, seq string, own long"


class Cut(InputPartition):
    def __init__(self, file: str, start: int, end: int) -> None:
        self.file, self.start, self.end = file, start, end


class FastaSource(DataSource):
    """Options: path, a file or folder; cut, bytes of a task; piece, bases of a row; overlap, bases that a row shares with the next."""

    @classmethod
    def name(cls) -> str:
        return "sparkweave-fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return FastaReader(self.options)


class FastaReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path = options["path"]
        self.cut, self.piece, self.overlap = (int(options.get(k, d)) for k, d in (("cut", 64 << 20), ("piece", 4 << 20), ("overlap", 3)))

    def partitions(self) -> list[Cut]:
        store, at = _opened(self.path)
        info = store.get_file_info(at)
        files = [info] if info.is_file else sorted((f for f in store.get_file_info(fs.FileSelector(at)) if f.is_file), key=lambda f: f.path)
        return [Cut(f.path, lo, min(lo + self.cut, f.size)) for f in files for lo in range(0, f.size, self.cut)]

    def read(self, partition: Cut) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        with store.open_input_file(partition.file) as file:
            yield from pieces(file, partition, self.piece, self.overlap)


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _read(file, start: int, size: int) -> bytes:  # noqa: ANN001
    file.seek(start)
    return file.read(size)


def _bases(raw: bytes) -> bytes:
    return b"".join(raw.split())


def _ahead(file, at: int, bases: int) -> bytes:  # noqa: ANN001
    """The first bases of a sequence that goes on at an offset, fewer where its record ends."""
    out, raw = b"", _read(file, at - 1, 1)  # a line's end there makes a sign behind it a header
    while len(out) < bases and (more := _read(file, at - 1 + len(raw), CHUNK)):
        raw += more
        head = raw.find(b"\n>")
        out = _bases(raw[1 : max(1, head) if head >= 0 else None])
        if head >= 0:
            break
    return out[:bases]


def pieces(file, cut: Cut, piece: int, overlap: int) -> Iterator[tuple]:  # noqa: ANN001
    """Rows of SCHEMA of a cut: own is how many bases of seq begin in the piece; record, its header's offset, and header are null where a cut before has it.

    A header belongs to the cut in which it begins; a record without bases is a row without any."""
    raw = _read(file, cut.start, cut.end - cut.start)
    before = _read(file, max(0, cut.start - LONGEST_HEADER), min(cut.start, LONGEST_HEADER))
    line = before.rpartition(b"\n")[2]  # what the cut's first line has before it
    skip = 0
    if line.startswith(b">") and (len(line) < len(before) or cut.start <= LONGEST_HEADER):  # the rest of a header
        skip = len((raw + _read(file, cut.end, LONGEST_HEADER)).partition(b"\n")[0]) + 1
    heads = [m.end() - 1 for m in re.finditer(rb"(?:\A|\n)>", raw) if m.end() > 1 or not line]
    parts = [(None, None, skip, heads[0] if heads else len(raw))]
    for at, end in zip(heads, [*heads[1:], len(raw)][: len(heads)], strict=True):
        name = raw[at + 1 : end].partition(b"\n")[0]
        if at + 1 + len(name) == len(raw):  # goes on behind the cut
            name += _read(file, cut.end, LONGEST_HEADER).partition(b"\n")[0]
        parts.append((cut.start + at, (name.split() or [b""])[0].decode("utf-8", "replace"), at + 1 + len(name) + 1, end))
    for k, (record, header, lo, hi) in enumerate(parts):
        body = _bases(raw[lo:hi])
        whole = body + (_ahead(file, max(cut.end, cut.start + lo), overlap) if k == len(parts) - 1 else b"")
        for at in range(0, len(body) or (record is not None), piece):
            yield cut.file, cut.start, cut.start + lo + at, record, header, whole[at : at + piece + overlap].decode("latin-1"), min(piece, len(body) - at)


def read_fasta_pieces(spark: SparkSession, path: str, k: int = 4, cut: int = 64 << 20, piece: int = 4 << 20) -> DataFrame:
    """(file, record, contig_id, header, coverage, seq, own, offset): sequences in pieces that overlap by k - 1 bases.

    (file, record) names a record, also where contig_id repeats."""
    spark.dataSource.register(FastaSource)
    rows = spark.read.format(FastaSource.name()).options(path=path, cut=cut, piece=piece, overlap=k - 1).load()
    # One row per cut with the header that is in force at its end, carried on over cuts without one.
    last = rows.groupBy("file", "cut").agg(F.max(F.struct("record", "header")).alias("last"))
    last = last.withColumn("last", F.when(F.col("last.record").isNotNull(), F.col("last")))
    carried = last.select("file", "cut", F.expr("last(last, true) OVER (PARTITION BY file ORDER BY cut ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)").alias("_last"))
    known = rows.join(carried, ["file", "cut"]).withColumn("header", F.coalesce("header", "_last.header")).withColumn("record", F.coalesce("record", "_last.record"))
    known = known.filter("header <> ''")
    return known.select("file", "record", contig_id(F.col("header")).alias("contig_id"), "header", header_coverage(F.col("header")).alias("coverage"), "seq", "own", "offset")


def contigs_of_pieces(rows: DataFrame) -> DataFrame:
    """(contig_id, header, length, coverage, _at) of the records of pieces; _at follows their order in the files."""
    one = rows.groupBy("file", "record").agg(F.first("contig_id").alias("contig_id"), F.first("header").alias("header"), F.sum("own").alias("length"), F.first("coverage").alias("coverage"))
    return one.select("contig_id", "header", "length", "coverage", F.struct("file", "record").alias("_at"))

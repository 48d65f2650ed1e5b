"""Canonical k-mer counts and profiles.

A sequence is turned into the codes of all its k-mers at once, two bits a base, and these are counted where the row is:
nothing is exchanged, and only one row per sequence, or per k-mer that it has, leaves Python. Long sequences are
taken a piece at a time. Rows of a small input are dealt to all cores first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkweave.functions.sequences import ALPHABET, canonical_kmers

LEAST_LENGTH = 1000
#: Longest k whose k-mers are counted in a dense array; longer ones are sorted.
DENSE = 8
#: Bases that are coded at once.
PIECE = 1 << 20
#: Bytes of input for each core below which rows are dealt anew.
SMALL = 64 << 20

_CODE = np.zeros(256, np.uint8)  # whatever isn't a base counts as A
for _k, _base in enumerate(ALPHABET):
    _CODE[ord(_base)] = _k


def spread(df: DataFrame) -> DataFrame:
    """df with rows dealt to all cores where Catalyst expects few bytes for each, as one small file would be one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL else df


def kmer_codes(seq: str, k: int) -> Iterator[np.ndarray]:
    """The canonical codes of a sequence's k-mers: the lower of each k-mer's and its reverse complement's, piece by piece."""
    base = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    kind = np.uint16 if k <= DENSE else np.int64
    for at in range(0, len(base) - k + 1, PIECE):
        b = base[at : at + PIECE + k - 1].astype(kind)
        n = len(b) - k + 1
        there, back = np.zeros(n, kind), np.zeros(n, kind)
        for j in range(k):
            there += b[j : j + n] << kind(2 * (k - 1 - j))
            back += (3 - b[j : j + n]) << kind(2 * j)
        yield np.minimum(there, back)


def code_counts(seq: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes that a sequence has, in order, and how often."""
    if k <= DENSE:
        n = sum((np.bincount(c, minlength=4**k) for c in kmer_codes(seq, k)), np.zeros(4**k, np.int64))
        return np.flatnonzero(n), n[np.flatnonzero(n)]
    code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for c in kmer_codes(seq, k):
        code, at = np.unique(np.concatenate([code, c]), return_inverse=True)
        n = np.bincount(at, np.concatenate([n, np.ones(len(c), np.int64)])).astype(np.int64)
    return code, n


def _names(code: np.ndarray, k: int) -> pa.Array:
    signs = np.frombuffer(ALPHABET.encode(), np.uint8)[(code[:, None] >> (2 * np.arange(k - 1, -1, -1))) & 3]
    return pa.array(signs.copy().view(f"S{k}").ravel().astype(str) if len(code) else [], pa.string())


def _in_tasks(seqs: DataFrame, key: str, columns: str, make) -> DataFrame:
    """seqs (key, seq) through make(keys, sequences), a dict of the columns and of the row that each value belongs to, as `at`."""
    kind = seqs.schema[key].dataType.simpleString()
    schema = StructType.fromDDL(f"`{key}` {kind}, {columns}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                at, *values = make(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *values], schema.names)

    return spread(seqs.select(key, "seq")).mapInArrow(run, schema)


def kmer_counts(seqs: DataFrame, k: int = 4, key: str = "vid") -> DataFrame:
    """(key, kmer, n, total): canonical k-mers of each row of seqs (key, seq), with the row's number of k-mers; null and short sequences have none."""

    def make(column: pa.Array) -> tuple[pa.Array, ...]:
        found = [code_counts(s or "", k) for s in column.to_pylist()]
        times = [len(c) for c, _ in found]
        code, n = (np.concatenate([x[j] for x in found]).astype(np.int64) for j in (0, 1))
        total = np.array([int(n.sum()) for _, n in found], np.int64)
        return pa.array(np.repeat(np.arange(len(found)), times)), _names(code, k), pa.array(n), pa.array(np.repeat(total, times))

    return _in_tasks(seqs, key, "kmer string, n long, total long", make)


def kmer_shares(counts: DataFrame, key: str = "vid") -> DataFrame:
    """(key, kmer, share): counts divided by the sequence's number of k-mers."""
    return counts.select(key, "kmer", (F.col("n") / F.col("total")).alias("share"))


def merged(counts: DataFrame, key: str = "vid") -> DataFrame:
    """The counts of sequences that come in pieces, added up by key; total is that of the whole sequence."""
    whole = counts.groupBy(key, "kmer").agg(F.sum("n").alias("n"))
    return whole.withColumn("total", F.expr(f"sum(n) OVER (PARTITION BY `{key}`)"))


def profiles(seqs: DataFrame, k: int = 4, key: str = "vid", least: int = LEAST_LENGTH) -> DataFrame:
    """(key, profile): the dense profile of each sequence of at least `least` characters, in order of the k-mers."""
    own = np.array([int("".join(str(ALPHABET.index(x)) for x in name), 4) for name in canonical_kmers(k)])

    def make(column: pa.Array) -> tuple[pa.Array, ...]:
        out = np.zeros((len(column), len(own)))
        for row, s in zip(out, column.to_pylist(), strict=True):
            code, n = code_counts(s or "", k)
            row[np.searchsorted(own, code)] = n / max(1, n.sum())
        return pa.array(np.arange(len(out))), pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * len(own)), pa.array(out.ravel()))

    return _in_tasks(seqs.filter(F.length("seq") >= least), key, "profile array<double>", make)


def merged_profiles(counts: DataFrame, k: int = 4, key: str = "vid") -> DataFrame:
    """(key, profile) from merged counts."""
    held = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("kmer", "n"))).alias("m"), F.max("total").alias("_all"))  # at most the k-mers that there are
    names = F.array(*[F.lit(x) for x in canonical_kmers(k)])
    return held.select(key, F.transform(names, lambda x: F.coalesce(F.element_at("m", x), F.lit(0)) / F.col("_all")).alias("profile"))

"""Sequence expressions: reverse complement, k-mer codes, canonical k-mers, header parts."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The bases in the order of their codes, and what follows a contig's name in its header.
ALPHABET = "ACGT"
SUFFIX = "_length_[0-9]+_cov_[0-9]+(.)*$"


def letters_as_bases(text: Column) -> Column:
    """Any text as a sequence: its ASCII letters in turn stand for the four bases."""
    turns = "".join(ALPHABET[k % 4] for k in range(26))
    return F.translate(F.regexp_replace(F.lower(text), "[^a-z]", ""), "abcdefghijklmnopqrstuvwxyz", turns)


def only_bases(seq: Column) -> Column:
    """Every character beside the four capital bases counts as A."""
    return F.regexp_replace(seq, "[^ACGT]", "A")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def kmer_code(kmer: Column) -> Column:
    """Two bits for each base."""
    return F.conv(F.translate(only_bases(kmer), "ACGT", "0123"), 4, 10).cast("long")


def canonical(kmer: Column) -> Column:
    return F.least(kmer, reverse_complement(kmer))


def canonical_kmers(k: int = 4) -> list[str]:
    """In order, the k-mers that don't come after their reverse complement."""
    turn = str.maketrans("ACGT", "TGCA")
    return [x for x in map("".join, product(ALPHABET, repeat=k)) if x <= x.translate(turn)[::-1]]


def contig_id(header: Column) -> Column:
    return F.regexp_replace(header, SUFFIX, "")


def header_length(header: Column) -> Column:
    return F.element_at(F.split(header, "_"), 4).cast("long")


def header_coverage(header: Column) -> Column:
    return F.element_at(F.split(header, "_"), 6).cast("double")


def flipped(segment: Column) -> Column:
    """The segment in the other orientation; what doesn't end in + becomes +."""
    return F.concat(F.substring(segment, F.lit(1), F.length(segment) - 1), F.when(segment.endswith("+"), "-").otherwise("+"))

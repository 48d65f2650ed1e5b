"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next one.

Language ID drops documents that have no letter, lie far from every language, or as near to two; the n-gram Jaccard join keeps one document of each
group of near copies; decontamination drops documents that hold benchmark passages; personal data is masked
in the texts; best-fit packing lays the rest out in sequences and returns where each piece went. All stages
but the last return the columns of documents.

Cases: null and empty texts have no letter and go at the first stage, a table without labels keeps all others; rows that
repeat an id and a text become one at the second stage, texts that differ under one id are judged each for itself, and rows
without an id stay and are packed; very long texts are taken whole; an empty table or benchmark gives empty or unchanged
tables; further columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm.common import dropped, written
from sparkweave.llm.decontaminate import drop_contaminated
from sparkweave.llm.jaccard import keep_one_of_each
from sparkweave.llm.language import keep_known_language
from sparkweave.llm.packing import pack_documents
from sparkweave.llm.pii import fit_pii, mask_pii

#: Near copies in the pipeline: shingles of five words, a similarity of 80 hundredths.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known_language(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, NEAR_PERCENT, NEAR_WORDS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_pii(docs, fit_pii(docs))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]
#: Trained models, set similarity in steps and tokenisation have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if k:  # what the stage before wrote is no longer read
            dropped([before])
    return STAGES[-1][1](spark, docs, sf_dir)

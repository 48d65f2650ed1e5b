"""The corpus operators' queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from sparkweave.llm.class_lm import op9_lm_scoring
from sparkweave.llm.decontaminate import op7_decontamination
from sparkweave.llm.divergence import OP11_SQL, op11_source_divergence_audit
from sparkweave.llm.filter_audit import OP12_SQL, op12_filter_interaction_audit
from sparkweave.llm.html_extract import op2_html_extraction
from sparkweave.llm.jaccard import OP5_SQL, op5_ngram_jaccard_join
from sparkweave.llm.language import op3_language_id
from sparkweave.llm.line_crf import op13_quality_classifier
from sparkweave.llm.packing import op8_best_fit_packing
from sparkweave.llm.pii import op10_pii
from sparkweave.llm.secrets import op4_secret_scan
from sparkweave.llm.sharding import OP1_SQL, op1_sharding
from sparkweave.llm.topk import OP6_SQL, op6_topk_search


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return import_module("corpus_pipeline").run(spark, sf_dir)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding,
        "op2_html_extraction": op2_html_extraction,
        "op3_language_id": op3_language_id,
        "op4_secret_scan": op4_secret_scan,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_topk_search": op6_topk_search,
        "op7_decontamination": op7_decontamination,
        "op8_best_fit_packing": op8_best_fit_packing,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_pii": op10_pii,
        "op11_source_divergence_audit": op11_source_divergence_audit,
        "op12_filter_interaction_audit": op12_filter_interaction_audit,
        "op13_quality_classifier": op13_quality_classifier,
        "pipeline": pipeline,
    }


def llm_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op5_ngram_jaccard_join": OP5_SQL, "op6_topk_search": OP6_SQL, "op11_source_divergence_audit": OP11_SQL, "op12_filter_interaction_audit": OP12_SQL}

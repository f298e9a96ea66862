"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from assayer.llm import queries as q
from assayer.llm import sql


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": q.op1_embedding_dedup,
        "op2_line_chunk_dedup": q.op2_line_chunk_dedup,
        "op3_best_fit_packing": q.op3_best_fit_packing,
        "op4_secrets": q.op4_secrets,
        "op5_toxicity": q.op5_toxicity,
        "op6_poisson_mixing": q.op6_poisson_mixing,
        "op7_quality_rules": q.op7_quality_rules,
        "op8_line_crf_quality": q.op8_line_crf_quality,
        "op9_pii": q.op9_pii,
        "op10_ngram_jaccard": q.op10_ngram_jaccard,
        "op11_weighted_centroids": q.op11_weighted_centroids,
        "op12_impact_search": q.op12_impact_search,
        "op13_byte_bpe": q.op13_byte_bpe,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_poisson_mixing": sql.poisson_mixing(), "op7_quality_rules": sql.quality_rules(), "op9_pii": sql.pii_spans(), "op11_weighted_centroids": sql.weighted_centroids(), "op12_impact_search": sql.impact_search()}

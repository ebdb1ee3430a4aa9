"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lorespan.llm import decontaminate, divergence, jaccard_join, license_scan, packing, piece_codec, pii, quality_mil, quality_rules, token_count, token_files, toxicity, vector_codes


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        toxicity.op1_toxicity,
        pii.op2_pii,
        decontaminate.op3_decontamination,
        token_count.op4_token_counts,
        license_scan.op5_license_scans,
        jaccard_join.op6_jaccard_join,
        quality_rules.op7_quality_rules,
        quality_mil.op8_quality_classifier,
        token_files.op9_token_files,
        packing.op10_best_fit_packing,
        divergence.op11_source_divergence,
        piece_codec.op12_piece_codec,
        vector_codes.op13_vector_codes,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": decontaminate.OP3_SQL, "op11_source_divergence": divergence.OP11_SQL, "op13_vector_codes": vector_codes.OP13_SQL}

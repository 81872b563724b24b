"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from evigrid.llm import chat, decontaminate, divergence, infill, line_dedup, nearest, ngram_join, packing, pii, quality, secrets_scan, token_files, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    functions = (
        ngram_join.op1_ngram_join,
        url_filter.op2_url_filters,
        chat.op3_chat_formatting,
        line_dedup.op4_line_dedup,
        nearest.op5_approximate_nearest_neighbours,
        packing.op6_packing,
        quality.op7_quality_classifier,
        secrets_scan.op8_secret_scan,
        pii.op9_personal_data,
        decontaminate.op10_benchmark_decontamination,
        token_files.op11_token_files,
        infill.op12_fill_in_middle,
        divergence.op13_source_divergence,
    )
    return {f.__name__: f for f in functions}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_ngram_join": ngram_join.ORACLE,
        "op2_url_filters": url_filter.ORACLE,
        "op3_chat_formatting": chat.ORACLE,
        "op10_benchmark_decontamination": decontaminate.ORACLE,
        "op12_fill_in_middle": infill.ORACLE,
        "op13_source_divergence": divergence.ORACLE,
    }

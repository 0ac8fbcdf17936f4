"""The queries of this subpackage, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audio, bpe, conversations, exact_dedup, language_id, lm, ngram_join, packing, quality, resampling, sharding, substring, url_filters

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": language_id.op1_language_id,
    "op2_packing": packing.op2_packing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_kd_sharding": sharding.op4_kd_sharding,
    "op5_ngram_join": ngram_join.op5_ngram_join,
    "op6_quality": quality.op6_quality,
    "op7_bpe": bpe.op7_bpe,
    "op8_katz": lm.op8_katz,
    "op9_chroma": audio.op9_chroma,
    "op10_url_filters": url_filters.op10_url_filters,
    "op11_conversation_repair": conversations.op11_conversation_repair,
    "op12_importance_resampling": resampling.op12_importance_resampling,
    "op13_substring_dedup": substring.op13_substring_dedup,
}
SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.SQL,
    "op10_url_filters": url_filters.SQL,
    "op11_conversation_repair": conversations.SQL,
    "op12_importance_resampling": resampling.SQL,
    "op13_substring_dedup": substring.SQL,
}

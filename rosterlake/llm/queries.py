"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rosterlake.llm import language_id, license_scan, lm_score, media_ts, mixing, near_dedup, piece_codec, sharding, target_resampling, token_counts, token_records, vector_codes, vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_lm_score": lm_score.op1_lm_score,
    "op2_language_id": language_id.op2_language_id,
    "op3_sentencepiece": piece_codec.op3_sentencepiece,
    "op4_token_records": token_records.op4_token_records,
    "op5_license_scan": license_scan.op5_license_scan,
    "op6_mixing": mixing.op6_mixing,
    "op7_exact_topk": vector_search.op7_exact_topk,
    "op8_media_ts": media_ts.op8_media,
    "op9_sharding": sharding.op9_sharding,
    "op10_near_dedup": near_dedup.op10_near_dedup,
    "op11_target_resampling": target_resampling.op11_target_resampling,
    "op12_vector_codes": vector_codes.op12_vector_codes,
    "op13_token_counts": token_counts.op13_token_counts,
}

ORACLES: dict[str, str] = {
    "op5_license_scan": license_scan.ORACLE,
    "op7_exact_topk": vector_search.ORACLE,
    "op10_near_dedup": near_dedup.ORACLE,
    "op11_target_resampling": target_resampling.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
}

"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, katz, language_id, packing, pii, quality, secrets, sentencepiece_codec, simhash, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii": pii.op1_pii,
        "op2_katz": katz.op2_katz,
        "op3_packing": packing.op3_packing,
        "op4_language_id": language_id.op4_language_id,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_secrets": secrets.op6_secrets,
        "op7_quality": quality.op7_quality,
        "op8_simhash": simhash.op8_simhash,
        "op9_sentencepiece": sentencepiece_codec.op9_sentencepiece,
        "op10_url_filter": url_filter.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_exact_dedup": exact_dedup.OP5_SQL, "op7_quality": quality.OP7_SQL, "op10_url_filter": url_filter.OP10_SQL}

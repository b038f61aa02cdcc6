"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, embedding_dedup, exact_dedup, mixing, packing, quality, simhash, suffix_dedup, token_output, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_packing": packing.op2_packing,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_quality": quality.op4_quality,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_chat_format": chat.op6_chat_format,
    "op7_simhash": simhash.op7_simhash,
    "op8_mixing": mixing.op8_mixing,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_token_output": token_output.op10_token_output,
}
SQL: dict[str, str] = {"op1_exact_dedup": exact_dedup.SQL, "op3_embedding_dedup": embedding_dedup.SQL, "op5_suffix_dedup": suffix_dedup.SQL}

"""The corpus queries and, where SQL can express one, its DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from spindrel.llm import ann, chat, gif, language, mixing, neardup, packing, pii, quality, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_duplicates": neardup.op1_near_duplicates,
        "op2_language": language.op2_language,
        "op3_chat": chat.op3_chat,
        "op4_urls": urls.op4_urls,
        "op5_mixing": mixing.op5_mixing,
        "op6_packing": packing.op6_packing,
        "op7_gif": gif.op7_gif,
        "op8_nearest": ann.op8_nearest,
        "op9_pii": pii.op9_pii,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_duplicates": neardup.ORACLE,
        "op3_chat": chat.ORACLE,
        "op4_urls": urls.ORACLE,
        "op5_mixing": mixing.ORACLE,
    }

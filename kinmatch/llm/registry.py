"""Queries of the corpus operators, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinmatch.llm import decontaminate, exact_dedup, html_text, language_id, mixing, near_dedup, quality, token_count, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_quality": quality.query,
        "op2_exact_dedup": exact_dedup.query,
        "op3_html_text": html_text.query,
        "op4_near_dedup": near_dedup.query,
        "op5_mixing": mixing.query,
        "op6_language_id": language_id.query,
        "op7_warc": warc.query,
        "op8_token_count": token_count.query,
        "op9_toxicity": toxicity.query,
        "op10_decontaminate": decontaminate.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.SQL, "op7_warc": warc.SQL}

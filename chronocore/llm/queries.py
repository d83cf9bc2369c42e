"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronocore.llm import decontam, exact, langid, lines, mixing, near, ngram_lm, passages, pii, urls


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_near_dedup": near.op1_near_dedup,
        "op2_line_dedup": lines.op2_line_dedup,
        "op3_mixing": mixing.op3_mixing,
        "op4_passage_dedup": passages.op4_passage_dedup,
        "op5_pii": pii.op5_pii,
        "op6_exact_dedup": exact.op6_exact_dedup,
        "op7_decontamination": decontam.op7_decontamination,
        "op8_lm_score": ngram_lm.op8_lm_score,
        "op9_language_id": langid.op9_language_id,
        "op10_url_filter": urls.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": lines.OP2_SQL, "op3_mixing": mixing.op3_sql(), "op6_exact_dedup": exact.OP6_SQL, "op10_url_filter": urls.op10_sql()}

"""Queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import collocations, decontaminate, forest, jaccard, language_model, pack, periods, pii, quality, secrets, substrings, toxicity, winnow


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_jaccard_join": jaccard.op1_jaccard_join,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_dedup": substrings.op3_dedup,
        "op4_fingerprint": winnow.op4_fingerprint,
        "op5_decontaminate": decontaminate.op5_decontaminate,
        "op6_secrets": secrets.op6_secrets,
        "op7_quality": quality.op7_quality,
        "op8_pack": pack.op8_pack,
        "op9_pii": pii.op9_pii,
        "op10_lm_score": language_model.op10_lm_score,
        "op11_periods": periods.op11_periods,
        "op12_near_dedup": forest.op12_near_dedup,
        "op13_collocations": collocations.op13_collocations,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_decontaminate": decontaminate.SQL, "op12_near_dedup": forest.SQL, "op13_collocations": collocations.SQL} | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})

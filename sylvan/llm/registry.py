"""The queries op1 to op10 and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import decontamination, jaccard, langid, lattice, linededup, mixing, quality, topk, toxicity, wrappers
from sylvan.llm.common import small_batches


def _query(operator: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return operator(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_jaccard": jaccard.op1_jaccard,
        "op2_langid": langid.op2_langid,
        "op3_quality": quality.op3_quality,
        "op4_topk": topk.op4_topk,
        "op5_lattice": lattice.op5_lattice,
        "op6_linededup": linededup.op6_linededup,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_mixing": mixing.op8_mixing,
        "op9_wrappers": wrappers.op9_wrappers,
        "op10_decontamination": decontamination.op10_decontamination,
    }
    return {name: _query(operator) for name, operator in found.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_jaccard": jaccard.SQL,
        "op4_topk": topk.SQL,
        "op10_decontamination": decontamination.SQL,
    }

"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stepfold.llm import bitsliced, ctxmix, decontam, langid, mixing, neardup, pii, sharding, suffixdup, toxicity
from stepfold.llm.common import table


def op1_template_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.two_pass_shuffle(table(spark, sf_dir, "documents"))


def op4_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctxmix.score(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixdup.report(table(spark, sf_dir, "documents"))


def op6_multiindex_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"))


def op7_hypergeometric_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents"))


def op8_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"))


def op9_ftrl_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op10_pii_deobfuscate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_template_decontam, op2_nnpu_toxicity, op3_two_pass_shuffle, op4_context_mixing, op5_suffix_dedup, op6_multiindex_neardup,
        op7_hypergeometric_mix, op8_bitsliced_topk, op9_ftrl_langid, op10_pii_deobfuscate,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {"op5_suffix_dedup": suffixdup.REPORT_SQL, "op6_multiindex_neardup": neardup.CLASSES_SQL, "op8_bitsliced_topk": bitsliced.TOP_K_SQL}

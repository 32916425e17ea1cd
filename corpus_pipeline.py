"""The corpus pipeline: toxic documents go, then near-duplicates, then benchmark leaks; then sources are mixed and sharded.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return
the columns of `documents`; the mix repeats and leaves out rows to meet its targets, and deals them out by
its tree; the last gives each row its shard and slot, with the whole row in `record`, in the order of slots.
Nulls, empty tables, repeated rows and clashing columns: see the operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepfold.llm import decontam, mixing, neardup, sharding, toxicity
from stepfold.llm.common import cut, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    place = "_mix_place"
    while place in docs.columns:
        place = f"_{place}"
    return mixing.in_places(mixing.mix(docs, place=place), place)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shuffle_records(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL can express neither the classifier nor the seeded hashes; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

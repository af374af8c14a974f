"""From raw documents to a training mix: five stages, each one of the operators of
leafmill.llm, each over everything that its predecessor kept.

run() gives the rows of documents that the mix takes, with size, epochs and taken. SQL can't
express SimHash components, so ORACLE_SQL is None and tests/llm compares the stages with
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm._shared import discard, materialize, table
from leafmill.llm.decontamination import drop_contaminated
from leafmill.llm.mixing import mix_rows
from leafmill.llm.quality_rules import keep_good
from leafmill.llm.simhash import drop_near_duplicates
from leafmill.llm.substring_dedup import dedup_substrings


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return keep_good(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates one row: the smallest id, nulls last, then by text."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has."""
    return dedup_substrings(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes, with size, epochs and taken."""
    return mix_rows(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", simhash_near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            discard(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

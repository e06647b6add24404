"""From raw documents to a training mixture: five stages, each the work of one operator of ``codetrials.llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from codetrials.llm import bitmask_langid, blob_ledger, lsh_forest, positional_index, raking
from codetrials.llm.queries import known_to_workers, table
from codetrials.plans.scratch import scratch_path


def identify_language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without a language, or hardly like any, go."""
    known_to_workers(spark)
    filters = bitmask_langid.fit(docs.where(~bitmask_langid.is_held_out()))
    return bitmask_langid.accepted(docs, filters)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class stays: of those with the smallest id, the first row."""
    known_to_workers(spark)
    return lsh_forest.deduplicated(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with at least a twentieth of their words in passages of the benchmark go."""
    return positional_index.clean(docs, table(spark, folder, "benchmark"))


def drop_secrets(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a secret go; the ledger is this run's own."""
    return blob_ledger.clean(docs, blob_ledger.Ledger(spark, scratch_path(spark, "ledger")))


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """A sample whose tokens follow the target shares of sources, languages and topics."""
    return raking.mixed(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", drop_secrets),
    ("mixture", mix_sources),
]

#: SQL can express neither the forest's classes nor the language filters; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, f"stage-{name}")
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

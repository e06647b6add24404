"""The dealt operators as named queries over whole tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrials.llm import (
    balanced_packing,
    bitmask_langid,
    blob_ledger,
    dataset_manifest,
    hard_negatives,
    lsh_forest,
    merkle_fixity,
    notice_search,
    positional_index,
    raking,
    rarity_digest,
    recompression,
    run_length_index,
)
from codetrials.plans.scratch import scratch_path

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def known_to_workers(spark: SparkSession) -> None:
    """Let Python workers import the library from where the driver has it, if it is not installed on them."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, paths) if x)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    known_to_workers(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_recompression_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return recompression.dedup(table(spark, folder, "documents"))


def op2_raked_mixture(spark: SparkSession, folder: str) -> DataFrame:
    return raking.mix(table(spark, folder, "documents"))


def op3_positional_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return positional_index.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op4_rarity_digest(spark: SparkSession, folder: str) -> DataFrame:
    return rarity_digest.fingerprints(table(spark, folder, "documents"))


def replica_of(pages: DataFrame) -> DataFrame:
    """A second copy of the pages with damage of a kind a store does: some bodies altered, some records lost."""
    altered = F.concat(F.substring("html", 1, 100), F.lit("?"), F.expr("substring(html, 102)"))
    html = F.when(F.col("page_id") % 97 == 13, altered).otherwise(F.col("html"))
    return pages.where(F.coalesce(F.col("page_id") % 211 != 7, F.lit(True))).withColumn("html", html)


def op5_merkle_fixity_audit(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    one, two = (merkle_fixity.Tree(merkle_fixity.archived(p)) for p in (pages, replica_of(pages)))
    return merkle_fixity.audit(one, two)


def op6_lsh_forest_join(spark: SparkSession, folder: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, folder, "documents")).drop("digest")


def op7_fuzzy_notices(spark: SparkSession, folder: str) -> DataFrame:
    return notice_search.search(table(spark, folder, "documents"))


def op8_blob_ledger(spark: SparkSession, folder: str) -> DataFrame:
    ledger = blob_ledger.Ledger(spark, scratch_path(spark, "ledger"))
    return blob_ledger.scan(table(spark, folder, "documents"), ledger)


def op9_bitmask_language(spark: SparkSession, folder: str) -> DataFrame:
    return bitmask_langid.identify(table(spark, folder, "documents"))


def op10_run_length_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return run_length_index.dedup(table(spark, folder, "documents"))


def op11_slot_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return dataset_manifest.audited(table(spark, folder, "documents"))


def op12_balanced_packing(spark: SparkSession, folder: str) -> DataFrame:
    return balanced_packing.pack(table(spark, folder, "documents"))


def op13_slot_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, folder, "embeddings"), label=label)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = [
        op1_recompression_dedup,
        op2_raked_mixture,
        op3_positional_decontamination,
        op4_rarity_digest,
        op5_merkle_fixity_audit,
        op6_lsh_forest_join,
        op7_fuzzy_notices,
        op8_blob_ledger,
        op9_bitmask_language,
        op10_run_length_dedup,
        op11_slot_manifest,
        op12_balanced_packing,
        op13_slot_negatives,
    ]
    return {f.__name__: f for f in named}

"""The runners end to end: operators put together, from input tables to results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrials.operators import coverage, jest, notebooks, summary, tasks, verdicts
from codetrials.schemas import COHORTS


def records_of_notebooks(books: DataFrame) -> DataFrame:
    """Read notebooks -> one task record per notebook, all inside the notebook's own row."""
    return notebooks.records_nested(books.where(F.col("reject_reason").isNull()))


def judged_runs(runs: DataFrame, languages: DataFrame, keys: Sequence[str], order: str = "run_id") -> DataFrame:
    """Verdicts of runs of mixed languages: ``languages`` has one row per ``task_id`` with its ``language``.

    Interpreted programs have no compile phase, so all languages go through one aggregation.  It combines before its
    shuffle and comes before the join with the languages: a task with very many runs reaches the join as one row per
    key, and nothing above the join needs its partitions whole, so the adaptive skew join can split it.  ``keys``
    include ``task_id``.  Runs without a supported language are in :func:`unjudged_runs`.
    """
    compiled = F.col("language").isin("C++", "Java")
    typed = tasks.route_language(languages).select("task_id", "language")
    both = verdicts.last_outcomes(runs, keys, order).join(typed, "task_id")
    return verdicts.judge_outcomes(both.where(compiled | F.col("_ran").isNotNull()), keys, compiled)


def unjudged_runs(runs: DataFrame, languages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(*keys, reject_reason)`` of the runs that :func:`judged_runs` leaves out for their task or language."""
    known = languages.select("task_id", "language", F.lit(True).alias("_known"))
    typed = runs.select(*keys).distinct().join(known, "task_id", "left")
    reason = F.when(F.col("_known").isNull(), "unknown task").otherwise("unsupported language")
    return tasks.skipped_language(typed).select(*keys, reason.alias("reject_reason"))


def checked_tasks(records: DataFrame) -> DataFrame:
    """Task records with their tests decoded and a reason where a record cannot be used."""
    listed = "test_list" if "test_list" in records.columns else None
    return tasks.check_tasks(tasks.decode_tests(records, listed=listed))


def java_results(
    runs: DataFrame, jacoco: DataFrame, keys: Sequence[str] = ("task_id", "impl"), keep: Sequence[str] = (),
    platform: str = "mac",
) -> DataFrame:
    """Java runs -> results with coverage; a run whose report has a rejected row failed to run."""
    results = verdicts.classify_gradle(runs, keys, platform, keep)
    if "reject_reason" in jacoco.columns:
        results = coverage.fail_rejected(results, coverage.rejected_reports(jacoco, keys), keys)
    return coverage.attach_coverage(results, coverage.jacoco_totals(jacoco, keys), keys)


def jest_results(outputs: DataFrame, version: str = "v2") -> DataFrame:
    """Jest outputs -> the last status of every implementation."""
    return jest.test_summary(jest.classify_jest(jest.parse_jest(outputs), version))


def pass_rates(runs: DataFrame, keys: Sequence[str] = ("task_id", "impl"), order: str = "run_id") -> DataFrame:
    """Pass rate per cohort of implementations over compiled programs."""
    judged = verdicts.classify_compiled(runs, keys, order, with_output=False)
    results = judged.select(
        F.concat(F.col("impl"), F.lit(".java")).alias("file_name"),
        F.when(F.col("status") == "PASS", "PASSED")
        .when(F.col("status") == "COMPILE ERROR", "FAILED_TO_RUN")
        .otherwise("FAILED")
        .alias("status"),
    )
    return summary.cohort_stats(results, "file_name", COHORTS)

"""Counts over results: overall, per cohort, newest result and history per implementation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import base_name, ratio_pct
from codetrials.operators.coverage import PLURALS
from codetrials.operators.ordered import SLIM_BITS, lag_within, newest
from codetrials.schemas import COHORTS

Cohorts = Sequence[tuple[str, str, str]]


def status_counts(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """``(*keys, total, passed, failed, failed_to_run)``."""
    return results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.count_if(F.col("status") == status.upper()).alias(status)
            for status in ("passed", "failed", "failed_to_run")
        ],
    )


def is_letter_file(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z]\.java\z")


def letter_files(results: DataFrame, name: str = "file_name") -> DataFrame:
    """Results of files named with a single letter."""
    return results.where(is_letter_file(base_name(name)))


def cohort_of(name: Column, cohorts: Cohorts = COHORTS) -> Column:
    """Cohort of a file name by its letter, NULL outside all ranges.

    The ranges are parameters, not data, so this is a projection: no join, no shuffle.
    """
    letter = F.upper(F.substring(name, 1, 1))
    found: Column = F.lit(None).cast("string")
    for cohort, low, high in reversed(list(cohorts)):
        found = F.when(letter.between(F.lit(low), F.lit(high)), cohort).otherwise(found)
    return F.when(is_letter_file(name), found)


def assign_cohort(results: DataFrame, name: str = "file_name", cohorts: Cohorts = COHORTS) -> DataFrame:
    return results.withColumn("cohort", cohort_of(base_name(name), cohorts))


def figures(cohorts: Cohorts, status: Column, cohort: Column, rows: Column) -> list[Column]:
    """Aggregates of the overall counts and those of every cohort.  The cohorts are parameters, so they are columns: an
    empty one is there with its zeros.  ``rows`` is how many results a row stands for."""
    counted = lambda c: F.coalesce(F.sum(F.when(c, rows)), F.lit(0)).cast("bigint")
    bad = status.isin("FAILED", "FAILED_TO_RUN")
    out = [counted(F.lit(True)).alias("total"), *[counted(status == s.upper()).alias(s) for s in ("passed", "failed", "failed_to_run")]]
    for i, (name, _, _) in enumerate(cohorts):
        inside = cohort == name
        out += [
            counted(inside).alias(f"_total_{i}"),
            counted(inside & (status == "PASSED")).alias(f"_passed_{i}"),
            counted(inside & bad).alias(f"_failed_{i}"),
        ]
    return out


def cohort_figures(cohorts: Cohorts) -> Column:
    """``ARRAY<STRUCT<cohort, total, passed, failed>>`` out of the columns of :func:`figures`."""
    return F.array(
        *[
            F.struct(F.lit(name).alias("cohort"), *[F.col(f"_{figure}_{i}").alias(figure) for figure in ("total", "passed", "failed")])
            for i, (name, _, _) in enumerate(cohorts)
        ]
    )


def summary_figures(results: DataFrame, name: str = "file_name", cohorts: Cohorts = COHORTS) -> DataFrame:
    """One row: ``total, passed, failed, failed_to_run`` and ``cohorts ARRAY<STRUCT<cohort, total, passed, failed>>``.

    All figures come from one pass, as columns of a global aggregate: every task sends a single row.
    """
    named = results.select(cohort_of(base_name(name), cohorts).alias("cohort"), "status")
    return named.agg(*figures(cohorts, F.col("status"), F.col("cohort"), F.lit(1))).select(
        "total", "passed", "failed", "failed_to_run", cohort_figures(cohorts).alias("cohorts")
    )


def all_figures(
    results: DataFrame, task: str = "task_id", name: str = "file_name", cohorts: Cohorts = COHORTS
) -> DataFrame:
    """``(level, task_id, cohort, total, passed, failed, failed_to_run, <kind>_coverage)`` of every task, every cohort and
    all results, from one pass by grouping sets.

    ``level`` is ``task``, ``cohort`` or ``overall``; results outside all cohorts are in no row of that level, and a cohort
    without results, or any level of an empty table, has no row.  Coverage is weighted by size over the PASSED results that have one
    (column ``coverage``, optional); it is 0 where nothing was counted.
    """
    covered = (F.col("status") == "PASSED") & F.col("coverage").isNotNull() if "coverage" in results.columns else None
    sides = [f"{side}_{plural}" for plural in PLURALS.values() for side in ("total", "covered")]
    sizes = [(F.lit(0) if covered is None else F.when(covered, F.col(f"coverage.{c}"))).alias(f"_{c}") for c in sides]
    rows = results.select(
        F.col(task).alias("task_id"), cohort_of(base_name(name), cohorts).alias("cohort"), F.col("status").alias("_status"), *sizes
    )
    grouped = rows.groupingSets([["task_id"], ["cohort"], []], "task_id", "cohort").agg(
        F.grouping_id().alias("_level"),
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("_status") == s.upper()).alias(s) for s in ("passed", "failed", "failed_to_run")],
        *[F.sum(f"_{c}").alias(f"_{c}") for c in sides],
    )
    level = F.when(F.col("_level") == 1, "task").when(F.col("_level") == 2, "cohort").otherwise("overall")
    coverage = [ratio_pct(f"_covered_{plural}", f"_total_{plural}").alias(f"{kind}_coverage") for kind, plural in PLURALS.items()]
    return grouped.where((F.col("_level") != 2) | F.col("cohort").isNotNull()).select(
        level.alias("level"), "task_id", "cohort", "total", "passed", "failed", "failed_to_run", *coverage
    )


def cohort_stats(results: DataFrame, name: str = "file_name", cohorts: Cohorts = COHORTS) -> DataFrame:
    """``(cohort, total, passed, failed, pass_pct, fail_pct)``, a row of zeros for an empty cohort."""
    return (
        summary_figures(results, name, cohorts)
        .select(F.inline("cohorts"))
        .select(
            "*",
            ratio_pct("passed", "total").alias("pass_pct"),
            ratio_pct("failed", "total").alias("fail_pct"),
        )
    )


def last_writer_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The newest row per key."""
    return newest(df, keys, order)


def log_history(
    logs: DataFrame, keys: Sequence[str], seq: str, status: str = "status", bits: int | None = SLIM_BITS
) -> DataFrame:
    """Every log entry with the status of the entry before it and whether it changed."""
    past = lag_within(logs, keys, seq, status, "previous_status", bits)
    return past.withColumn(
        "changed", F.col("previous_status").isNotNull() & (F.col("previous_status") != F.col(status))
    )


def log_totals(logs: DataFrame, keys: Sequence[str], seq: str, status: str = "status") -> DataFrame:
    """``(*keys, entries, latest, latest_status)``."""
    return logs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entries"),
        F.max(seq).alias("latest"),
        F.max_by(status, seq).alias("latest_status"),
    )

"""Coverage counters: totals per report, attachment to results, weighted overall figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import ratio_pct
from codetrials.schemas import JACOCO_COUNTERS, JACOCO_KINDS

# Classes of the test framework itself.
FRAMEWORK_PREFIXES = ["org.junit", "org.mockito"]
# Plural names of the counted things.
PLURALS = {"instruction": "instructions", "branch": "branches", "line": "lines"}


def app_classes(jacoco: DataFrame, column: str = "class") -> DataFrame:
    """Rows of the application's own classes.  Real reports keep the package in a column of its own: pass
    ``column="package"`` to test that one."""
    out = jacoco
    for prefix in FRAMEWORK_PREFIXES:
        out = out.where(F.col(column).isNull() | ~F.startswith(F.col(column), F.lit(prefix)))
    return out


def jacoco_totals(
    jacoco: DataFrame, keys: Sequence[str] = ("task_id", "impl"), column: str = "class"
) -> DataFrame:
    """``(*keys, total_<x>, covered_<x>, <x>_coverage)`` for instructions, branches and lines; no code gives 0 %.

    A report with a rejected row has no totals, since a part of them would look like the whole; it is in
    ``rejected_reports``.
    """
    counted = app_classes(jacoco, column)
    figures = [F.sum(counter).cast("bigint").alias(f"_{counter}") for counter in JACOCO_COUNTERS]
    if "reject_reason" in jacoco.columns:
        sums = counted.groupBy(*keys).agg(*figures, F.count("reject_reason").alias("_bad")).where("_bad = 0")
    else:
        sums = counted.groupBy(*keys).agg(*figures)
    out = []
    for kind in JACOCO_KINDS:
        covered = F.col(f"_{kind}_covered")
        total = covered + F.col(f"_{kind}_missed")
        out += [
            total.alias(f"total_{PLURALS[kind]}"),
            covered.alias(f"covered_{PLURALS[kind]}"),
            ratio_pct(covered, total).alias(f"{kind}_coverage"),
        ]
    return sums.select(*keys, *out)


def rejected_reports(
    jacoco: DataFrame, keys: Sequence[str] = ("task_id", "impl"), column: str = "class"
) -> DataFrame:
    """``(*keys, reject_reason, rejected_rows)`` of the reports that ``jacoco_totals`` leaves out."""
    return (
        app_classes(jacoco, column)
        .where(F.col("reject_reason").isNotNull())
        .groupBy(*keys)
        .agg(F.min("reject_reason").alias("reject_reason"), F.count("*").alias("rejected_rows"))
    )


def fail_rejected(
    results: DataFrame, rejected: DataFrame, keys: Sequence[str] = ("task_id", "impl")
) -> DataFrame:
    """Results whose status is FAILED_TO_RUN, with the reason as their error, where a passed run's report is rejected."""
    reasons = rejected.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("reject_reason").alias("_reason"))
    match = F.col("status") == "PASSED"
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    joined = results.join(reasons, match, "left")
    bad = F.col("_reason").isNotNull()
    return joined.withColumns(
        {"status": F.when(bad, "FAILED_TO_RUN").otherwise(F.col("status")), "error": F.coalesce("_reason", "error")}
    ).drop("_reason", *[f"_{k}" for k in keys])


def attach_coverage(
    results: DataFrame, totals: DataFrame, keys: Sequence[str] = ("task_id", "impl")
) -> DataFrame:
    """Results plus ``coverage`` (a struct of the totals), only where the status is PASSED and a report exists."""
    fields = [c for c in totals.columns if c not in keys]
    packed = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.struct(*fields).alias("coverage"))
    match = F.col("status") == "PASSED"
    for k in keys:
        match = match & (F.col(k) == F.col(f"_{k}"))
    return results.join(packed, match, "left").drop(*[f"_{k}" for k in keys])


def overall_coverage(results: DataFrame) -> DataFrame:
    """One row of percentages over all PASSED results with coverage, weighted by size."""
    parts = results.where((F.col("status") == "PASSED") & F.col("coverage").isNotNull())
    sums = parts.agg(
        *[
            F.sum(f"coverage.{side}_{name}").alias(f"{side}_{name}")
            for name in PLURALS.values()
            for side in ("total", "covered")
        ]
    )
    pct = {kind: ratio_pct(f"covered_{name}", f"total_{name}") for kind, name in PLURALS.items()}
    return sums.select(
        pct["line"].alias("overall_coverage"),
        *[value.alias(f"{kind}_coverage") for kind, value in pct.items()],
    )

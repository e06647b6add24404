"""Jest JSON output: parsing, verdicts, per-implementation summary, single test cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import let
from codetrials.schemas import JEST_REPORT

VERSIONS = ("v1", "v2")
# Verdicts on a run.
STATUSES = ("PASSED", "FAILED", "ERROR")


def _is_json(text: Column) -> Column:
    """The whole text is one JSON value.

    The JVM parser stops after the first value and ignores what follows; putting the text into an array and into an
    object leaves no text that passes both and is not a single value.  Both functions only walk over the tokens.
    """
    in_array = F.json_array_length(F.concat(F.lit("["), text, F.lit("]")))
    in_object = F.json_object_keys(F.concat(F.lit('{"v":'), text, F.lit("}")))
    return F.coalesce(in_array == 1, F.lit(False)) & in_object.isNotNull()


def parse_jest(df: DataFrame, json_col: str = "stdout") -> DataFrame:
    """Add ``parsed`` (BOOLEAN), ``passed``, ``total`` (NULL where absent) and ``suite`` (the first suite or NULL)."""
    text = F.coalesce(F.col(json_col), F.lit(""))
    read = let(
        _is_json(text),
        lambda ok: F.struct(ok.alias("parsed"), F.from_json(F.when(ok, text), JEST_REPORT).alias("_report")),
    )
    # As the output of a generator the report is parsed once per row: a filter on one of its fields would otherwise
    # be pushed below it together with a parse of its own.
    return df.select("*", F.inline(F.array(read))).withColumns(
        {
            "passed": F.col("_report.numPassedTests"),
            "total": F.col("_report.numTotalTests"),
            "suite": F.get(F.col("_report.testResults"), F.lit(0)),
        }
    ).drop("_report")


def jest_verdict(version: str = "v2", json_col: str = "stdout") -> Column:
    """``STRUCT<passed, total, status>`` from ``returncode`` and the columns of :func:`parse_jest`.

    v2 looks at the report alone: no suite is an ERROR, and 0 of 0 tests counts as PASSED.  v1 looks at
    ``returncode`` first: a clean exit with a readable suite compares the counts; a failed exit with a readable (or
    empty) report is FAILED with its counts; a failed exit without one is an ERROR.
    """
    if version not in VERSIONS:
        raise ValueError(f"unknown version {version!r}")
    has_suite = F.col("suite").isNotNull()
    zero = F.lit(0)
    passed, total = F.coalesce("passed", zero), F.coalesce("total", zero)
    if version == "v2":
        status = F.when(~has_suite, "ERROR").when(passed == total, "PASSED").otherwise("FAILED")
        counted = has_suite
    else:
        clean = F.coalesce(F.col("returncode") == 0, F.lit(False))
        readable = has_suite & F.col("suite.assertionResults").isNotNull()
        text = F.coalesce(F.col(json_col), F.lit(""))
        # An empty output stands for an empty report; a bare null cannot be read as one.
        report = (F.col("parsed") & (F.trim(text) != "null")) | (text == "")
        status = (
            F.when(clean & readable & F.col("passed").eqNullSafe(F.col("total")), "PASSED")
            .when(clean | report, "FAILED")
            .otherwise("ERROR")
        )
        counted = F.when(clean, readable).otherwise(report)
    return F.struct(
        F.when(counted, passed).otherwise(zero).alias("passed"),
        F.when(counted, total).otherwise(zero).alias("total"),
        status.alias("status"),
    )


def classify_jest(parsed: DataFrame, version: str = "v2", json_col: str = "stdout") -> DataFrame:
    """``parsed`` with ``status`` added and ``passed`` and ``total`` settled by :func:`jest_verdict`."""
    verdict = jest_verdict(version, json_col)
    return parsed.withColumns({name: verdict[name] for name in ("passed", "total", "status")})


def test_summary(
    classified: DataFrame, keys: Sequence[str] = ("task_id", "impl"), order: str = "run_id"
) -> DataFrame:
    """``(*keys, passed, total, status)``: the last run of each implementation.

    The status travels as its number, so that the aggregation hashes instead of sorting.
    """
    known = F.array(*[F.lit(s) for s in STATUSES])
    last = [
        F.max_by("passed", order).alias("passed"),
        F.max_by("total", order).alias("total"),
        F.max_by(F.array_position(known, F.col("status")), order).cast("int").alias("_status"),
    ]
    return classified.groupBy(*keys).agg(*last).select(
        *keys, "passed", "total", F.element_at(known, F.col("_status")).alias("status")
    )


def case_results(parsed: DataFrame, keys: Sequence[str] = ("task_id", "impl")) -> DataFrame:
    """One row per assertion: ``(*keys, pos, title, status, failure)``."""
    cases = parsed.where(F.col("suite").isNotNull()).select(
        *keys, F.posexplode("suite.assertionResults").alias("pos", "_case")
    )
    return cases.select(
        *keys,
        "pos",
        F.col("_case.title").alias("title"),
        F.col("_case.status").alias("status"),
        F.array_join("_case.failureMessages", "\n").alias("failure"),
    )

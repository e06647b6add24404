"""Report texts and summary lines.

A report about one run is composed inside that run's row, so no group is collected for it.  Reports about many rows
are tables of lines ordered by ``(section, seq)``; the sink sorts them, nothing brings them into one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import (
    base_name,
    file_stem,
    holds_any,
    pad_end,
    pct2,
    ratio_pct,
    report_lines,
    status_icon,
    strip_ansi,
)
from codetrials.operators.summary import Cohorts, cohort_figures, cohort_of, figures
from codetrials.schemas import COHORTS

# Marks, colours, rulers and labels of the report texts.
GREEN, RED, PLAIN = "\x1b[32m", "\x1b[31m", "\x1b[0m"
DIVISOR = "-" * 60
TITLE_RULE = "=" * 40
FAILED_TEXT = "Failed to run tests"
SUMMARY_TITLE = "Test Summary for "
IMPLEMENTATION, RUN, SUITES, TESTS = "\n# Testing implementation: ", "Test Run: ", "Test Suites: ", "Tests:       "
FENCE, END_FENCE = "```bash", "```"
JAVA_TITLE, JAVA_STAMP, JAVA_STATUS = "Test Results for ", "\nTimestamp: ", "\nStatus: "
JAVA_OUTPUT, JAVA_ERRORS = "\n\nTest Output:\n", "\nErrors:\n"
OVERVIEW_TITLE, OVERALL_TITLE = "Test Execution Summary", "Overall Results (All Files):"
STAMP, GENERATED = "Timestamp: ", "Generated: "
TOTAL_FILES, PASSED, FAILED, BROKEN = "Total files tested: ", "Passed: ", "Failed: ", "Failed to Run: "
MODELS_TITLE, MODEL_TITLE = "Model Comparison Statistics (Letter Files Only):", "{cohort} Model Tests ({low}-{high}):"
MODEL_TOTAL, MODEL_PASSED, MODEL_FAILED, MODEL_RATE = "Total tests: ", "Passed: ", "Failed/Failed to Run: ", "Pass Rate: "
DETAILS_TITLE = "Detailed Results:"
COVERAGE_TITLE, COVERAGE_HEAD = "Code Coverage Report", "Overall Coverage Metrics:"
COVERAGE_LABELS = {
    "overall_coverage": "Overall Coverage: ",
    "instruction_coverage": "Total Instruction Coverage: ",
    "branch_coverage": "Total Branch Coverage: ",
    "line_coverage": "Total Line Coverage: ",
}
PYTHON_TITLE, PYTHON_RULE = "Test Report for ", "\n" + "=" * 50 + "\n\n"
PYTHON_TESTS, PYTHON_COVERAGE = "TEST RESULTS:\n" + "-" * 20 + "\n", "\nCOVERAGE REPORT:\n" + "-" * 20 + "\n"


def _lines(*parts: Column | str) -> Column:
    """One array out of single lines (texts or columns) and arrays of lines."""
    return F.concat(*[F.array(F.lit(p)) if isinstance(p, str) else p for p in parts])


def _one(line: Column) -> Column:
    return F.array(line)


# --- Jest reports -----------------------------------------------------------------------------------------------


def _failures(case: Column) -> Column:
    return F.coalesce(case["failureMessages"], F.array().cast("array<string>"))


COLOURS = (GREEN, RED, PLAIN)
SHADE = "\uffff"  # in the place of a colour: keeps white space beside it from being trimmed, and is taken out
NO_COLOURS = ("", "", "")


def _mark(case: Column, colours: tuple[str, str, str]) -> Column:
    green, red, plain = colours
    mark = F.when(case["status"] == "passed", f"{green}✓{plain}").otherwise(f"{red}✕{plain}")
    return F.concat(mark, F.lit(" "), case["title"])


def _red(case: Column, colours: tuple[str, str, str]) -> Column:
    _, red, plain = colours
    return F.concat(F.lit(red), F.array_join(_failures(case), "\n"), F.lit(plain))


def _cases(version: str = "v2", colours: tuple[str, str, str] = COLOURS) -> Column:
    """Lines of the suite's cases, none where it does not list them."""
    return F.coalesce(case_lines(F.col("suite.assertionResults"), version, colours), F.array().cast("array<string>"))


def case_lines(cases: Column, version: str = "v2", colours: tuple[str, str, str] = COLOURS) -> Column:
    """Lines about all assertions of a suite: v2 has every mark first and then the failures, v1 puts each failure
    under its own mark."""
    if version == "v1":
        return F.flatten(
            F.transform(
                cases,
                lambda c: F.when(F.size(_failures(c)) > 0, F.array(_mark(c, colours), _red(c, colours))).otherwise(
                    F.array(_mark(c, colours))
                ),
            )
        )
    failed = F.filter(cases, lambda c: (c["status"] != "passed") & (F.size(_failures(c)) > 0))
    details = F.transform(
        failed, lambda c: F.array(F.lit("\t"), F.concat(F.lit("  ● "), c["title"]), _red(c, colours))
    )
    return F.concat(F.transform(cases, lambda c: _mark(c, colours)), F.flatten(details))


def _suite_lines(ok: Column, passed: Column, total: Column, colours: tuple[str, str, str] = COLOURS) -> list[Column]:
    green, red, plain = colours
    state = F.when(ok, f"{green}1 passed{plain}").otherwise(f"{red}1 failed{plain}")
    counts = F.concat(
        F.lit(TESTS), passed, F.lit(" passed, "), total - passed, F.lit(" failed, "), total, F.lit(" total")
    )
    return [F.concat(F.lit(SUITES), state), counts]


def jest_report(classified: DataFrame, stamp: Column, name: str = "impl") -> DataFrame:
    """Runs with a suite plus ``report``, their Markdown report, and its file name ``report_file``; ``stamp`` is the
    time to show."""
    passed, total = F.col("passed"), F.col("total")

    def log(colours: tuple[str, str, str]) -> Column:
        suites, tests = _suite_lines(passed == total, passed, total, colours)
        lines = _lines(
            _one(F.concat(F.lit(IMPLEMENTATION), F.col(name))), "\n", DIVISOR, FENCE, _cases("v2", colours),
            END_FENCE, DIVISOR, _one(F.concat(F.lit("\n"), suites)), _one(tests),
        )
        return F.array_join(lines, "\n")

    # Colours go again, so they are put in only where the run's own text has escape sequences that could join with them.
    own = F.concat_ws("", F.col(name), F.array_join(_cases("v2", NO_COLOURS), ""))
    odd = holds_any(own, f"\x1b\x9b{SHADE}")
    text = F.when(odd, report_lines(log(COLOURS))).otherwise(report_lines(log((SHADE, SHADE, SHADE)), SHADE))
    text = F.concat(F.lit(RUN), stamp, F.lit("\n\n"), text, F.lit("\n\n"))
    return classified.where(F.col("suite").isNotNull()).withColumns(
        {"report": text, "report_file": F.concat(F.col(name), F.lit("_report.md"))}
    )


def jest_console(classified: DataFrame) -> DataFrame:
    """Runs judged by the rules of v1 plus ``console``, what the first runner version shows for them.

    Marks and counts are shown after a clean exit with a readable suite.  A failed exit shows its error text in red if
    the report could be read, and ``FAILED_TEXT`` in red if not.  A clean exit without a suite shows nothing.  The
    column ``stderr`` is optional.
    """
    passed, total = F.col("passed"), F.col("total")
    suites, tests = _suite_lines(F.coalesce(F.col("suite.status") == "passed", F.lit(False)), passed, total)
    lines = _lines(_cases("v1"), _one(F.concat(F.lit("\n"), suites)), _one(tests))
    clean = F.coalesce(F.col("returncode") == 0, F.lit(False))
    errors = F.coalesce(F.col("stderr"), F.lit("")) if "stderr" in classified.columns else F.lit("")
    console = (
        F.when(clean & F.col("suite.assertionResults").isNotNull(), F.array_join(lines, "\n"))
        .when(~clean & (F.col("status") == "ERROR"), f"{RED}{FAILED_TEXT}{PLAIN}")
        .when(~clean & (errors != ""), F.concat(F.lit(RED), errors, F.lit(PLAIN)))
        .otherwise("")
    )
    return classified.withColumn("console", console)


def jest_summary_lines(summary: DataFrame, keys: Sequence[str] = ("task_id",), name: str = "impl") -> DataFrame:
    """``(*keys, section, seq, line)``: title lines per task, then one line per implementation (``seq`` is its
    name).

    The summary has one row per task and implementation, and is read once: of two grouping sets the one has these rows,
    the other the tasks.
    """
    title = F.concat(F.lit(SUMMARY_TITLE), F.col(keys[0]).cast("string"))
    row = F.concat(
        pad_end(name, 20), F.lit(": "), F.col("passed"), F.lit("/"), F.col("total"), F.lit(" tests ["), F.col("status"), F.lit("]")
    )
    entry = lambda section, seq, line: F.struct(F.lit(section).alias("section"), seq.alias("seq"), line.alias("line"))
    heads = [entry(0, F.lit(str(k)), line) for k, line in enumerate((title, F.lit(TITLE_RULE), F.lit("")))]
    all_ = [*keys, name, "passed", "total", "status"]
    both = summary.select(*all_).groupingSets([all_, list(keys)], *all_).agg(F.grouping_id().alias("_level"))
    lines = F.when(F.col("_level") == 0, F.array(entry(1, F.col(name), row))).otherwise(F.array(*heads))
    return both.select(*keys, F.inline(lines))


# --- Java reports -----------------------------------------------------------------------------------------------


def java_report(results: DataFrame, stamp: Column, name: str = "file_name") -> DataFrame:
    """Add ``report`` and its file name ``report_file``."""
    file = base_name(name)
    text = F.concat(
        F.lit(JAVA_TITLE), file,
        F.lit(JAVA_STAMP), stamp,
        F.lit(JAVA_STATUS), F.col("status"),
        F.lit(JAVA_OUTPUT), F.coalesce(F.col("output"), F.lit("")),
        F.when(F.coalesce(F.col("error"), F.lit("")) != "", F.concat(F.lit(JAVA_ERRORS), F.col("error"))).otherwise(""),
    )
    return results.withColumns(
        {"report": text, "report_file": F.concat(file_stem(file, "java"), F.lit(".txt"))}
    )


def _section(df: DataFrame, section: int, *lines: Column | str) -> DataFrame:
    """Lines out of each row of a small table, numbered in order."""
    return df.select(
        F.lit(section).alias("section"), F.posexplode(_lines(*[_one(F.lit(x) if isinstance(x, str) else x) for x in lines])).alias("at", "line")
    ).select("section", F.col("at").cast("bigint").alias("seq"), "line")


def _labelled(label: str, value: Column) -> Column:
    return F.concat(F.lit(label), value.cast("string"))


def summary_lines(
    results: DataFrame,
    seq: str,
    name: str = "file_name",
    cohorts: Cohorts = COHORTS,
    style: str = "emoji",
    stamp: Column | None = None,
) -> DataFrame:
    """``(section, seq, line)`` of the summary over all results: overall counts, one block per cohort, one line per
    file (``seq``, a BIGINT column, orders the files).

    The results are read once: of two grouping sets the one has a row for each file, the other the figures above them.
    """
    title: list[Column | str] = [OVERVIEW_TITLE, "=" * 21, ""]
    if stamp is not None:
        title += [F.concat(F.lit(STAMP), stamp), ""]
    overall = [
        OVERALL_TITLE, "-" * 27,
        _labelled(TOTAL_FILES, F.col("total")),
        _labelled(PASSED, F.col("passed")),
        _labelled(FAILED, F.col("failed")),
        _labelled(BROKEN, F.col("failed_to_run")),
        "",
    ]
    sections = [title, overall, [MODELS_TITLE, "-" * 44, ""]]
    blocks: list[Column | str] = []
    for i, (cohort, low, high) in enumerate(cohorts):
        block = F.col("cohorts")[i]
        blocks += [
            MODEL_TITLE.format(cohort=cohort.capitalize(), low=low, high=high), "-" * 24,
            _labelled(MODEL_TOTAL, block["total"]),
            _labelled(MODEL_PASSED, block["passed"]),
            _labelled(MODEL_FAILED, block["failed"]),
            F.concat(F.lit(MODEL_RATE), pct2(ratio_pct(block["passed"], block["total"]))),
        ]
        if style == "text":
            blocks.append("")
    sections += [blocks, [DETAILS_TITLE, "-" * 16]]
    lines = [
        F.struct(F.lit(section).alias("section"), F.lit(at).cast("bigint").alias("seq"), F.lit(line).alias("line"))
        for section, content in enumerate(sections)
        for at, line in enumerate(content)
    ]
    file = F.concat(status_icon("_status", style), F.lit(" "), F.col("_file"), F.lit(": "), F.col("_status"))
    detail = F.struct(F.lit(len(sections)).alias("section"), F.col("_seq").alias("seq"), file.alias("line"))
    rows = results.select(
        F.col(seq).cast("bigint").alias("_seq"), base_name(name).alias("_file"), F.col("status").alias("_status"),
        F.col("status").alias("_state"), cohort_of(base_name(name), cohorts).alias("_cohort"), F.lit(1).alias("_rows"),
    )
    # a row that stands for no result: the figures are there even if there are no results
    none = F.lit(None).cast("string")
    rows = rows.unionByName(
        results.sparkSession.range(1).select(
            F.lit(None).cast("bigint").alias("_seq"), none.alias("_file"), none.alias("_status"), none.alias("_state"), none.alias("_cohort"),
            F.lit(0).alias("_rows"),
        )
    )
    keys = ["_seq", "_file", "_status"]
    both = rows.groupingSets([keys, []], *keys).agg(
        F.grouping_id().alias("_level"), *figures(cohorts, F.col("_state"), F.col("_cohort"), F.col("_rows"))
    )
    both = both.withColumn("cohorts", cohort_figures(cohorts))
    made = F.when(F.col("_level") == 0, F.array_repeat(detail, F.col("total").cast("int"))).otherwise(F.array(*lines))
    return both.select(F.inline(made))


def coverage_lines(overall: DataFrame, stamp: Column | None = None) -> DataFrame:
    """``(section, seq, line)`` of the coverage report over one row of overall percentages."""
    title = [COVERAGE_TITLE, "=" * 19, ""]
    if stamp is not None:
        title += [F.concat(F.lit(GENERATED), stamp), ""]
    return _section(
        overall, 0, *title,
        COVERAGE_HEAD, "-" * 24,
        *[F.concat(F.lit(label), pct2(column)) for column, label in COVERAGE_LABELS.items()],
        "",
    )


# --- Python reports -----------------------------------------------------------------------------------------------


def python_report(
    logs: DataFrame, name: str = "script", test_output: str = "test_output", coverage: str = "coverage_output"
) -> DataFrame:
    """Add ``report``, test log and coverage text of a script without terminal colours, and ``report_file``."""
    text = F.concat(
        F.lit(PYTHON_TITLE), file_stem(name, "python"), F.lit(PYTHON_RULE),
        F.lit(PYTHON_TESTS), strip_ansi(test_output), F.lit(PYTHON_COVERAGE), strip_ansi(coverage),
    )
    return logs.withColumns(
        {"report": text, "report_file": F.concat(file_stem(name, "python"), F.lit("_report.txt"))}
    )


# --- reports over many rows -----------------------------------------------------------------------------------------


def collect_reports(lines: DataFrame, keys: Sequence[str], seq: str, line: str = "line") -> DataFrame:
    """Reports whose lines come from different rows, as an ordered table of lines.

    The lines of a report stay rows: they are range-partitioned and sorted by key and position, so a report with very
    many lines spans several partitions (and part files) in order instead of being collected into one value.
    """
    return (
        lines.select(*keys, seq, line)
        .repartitionByRange(*keys, seq)
        .sortWithinPartitions(*keys, seq)
    )

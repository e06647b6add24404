"""Coverage, cohorts, histories, summaries, layout rules."""

from __future__ import annotations

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codetrials.operators import coverage, layout, ordered, reports, summary

JACOCO = (
    "task_id string, impl string, class string, package string, instruction_missed long, instruction_covered long, "
    "branch_missed long, branch_covered long, line_missed long, line_covered long"
)


def test_jacoco_totals(spark):
    df = spark.createDataFrame(
        [
            ("t", "A", "X", "p", 1, 3, 0, 0, 2, 8),
            ("t", "A", "org.junit.Y", "p", 100, 0, 9, 9, 9, 9),
            ("t", "A", "org.mockitoX", "p", 100, 0, 9, 9, 9, 9),
            ("t", "B", "Z", "org.junit.api", 0, 0, 1, 0, 0, 0),
            ("t", "C", None, None, 0, 1, 0, 0, 0, 0),
        ],
        JACOCO,
    )
    assert rows(coverage.jacoco_totals(df)) == [
        ("t", "A", 4, 3, 75.0, 0, 0, 0.0, 10, 8, 80.0),
        ("t", "B", 0, 0, 0.0, 1, 0, 0.0, 0, 0, 0.0),
        ("t", "C", 1, 1, 100.0, 0, 0, 0.0, 0, 0, 0.0),
    ]
    assert rows(coverage.jacoco_totals(df, column="package").select("impl")) == [("A",), ("C",)]


def test_coverage_only_of_passed(spark):
    results = spark.createDataFrame(
        [("t", "A", "PASSED"), ("t", "B", "FAILED"), ("t", "C", "PASSED")], "task_id string, impl string, status string"
    )
    totals = coverage.jacoco_totals(
        spark.createDataFrame(
            [("t", "A", "X", "p", 0, 0, 0, 0, 2, 8), ("t", "B", "X", "p", 0, 0, 0, 0, 10, 0)], JACOCO
        )
    )
    attached = coverage.attach_coverage(results, totals)
    assert attached.columns == ["task_id", "impl", "status", "coverage"]
    assert rows(attached.select("impl", "coverage.covered_lines")) == [("A", 8), ("B", None), ("C", None)]
    assert rows(coverage.overall_coverage(attached)) == [(80.0, 0.0, 0.0, 80.0)]
    lines = [r.line for r in reports.coverage_lines(coverage.overall_coverage(attached)).orderBy("seq").collect()]
    assert lines[5:9] == [
        "Overall Coverage: 80.00%", "Total Instruction Coverage: 0.00%", "Total Branch Coverage: 0.00%",
        "Total Line Coverage: 80.00%",
    ]
    assert rows(coverage.overall_coverage(attached.where("false"))) == [(0.0, 0.0, 0.0, 0.0)]


def results(spark, *pairs):
    data = [(i, name, status) for i, (name, status) in enumerate(pairs)]
    return spark.createDataFrame(data, "n long, file_name string, status string")


def test_cohorts(spark):
    df = results(spark, ("k.java", "PASSED"), ("AB.java", "PASSED"), ("a.java", "PASSED"), ("E.java", "FAILED"), ("E.java", "FAILED_TO_RUN"), ("F.javax", "PASSED"))
    assert rows(summary.assign_cohort(df).select("n", "cohort")) == [
        (0, None), (1, None), (2, "first"), (3, "first"), (4, "first"), (5, None)
    ]
    assert rows(summary.cohort_stats(df)) == [
        ("first", 3, 1, 2, 1 / 3 * 100, 2 / 3 * 100), ("second", 0, 0, 0, 0.0, 0.0)
    ]
    assert rows(summary.letter_files(df).select("n")) == [(0,), (2,), (3,), (4,)]
    own = summary.cohort_stats(df, cohorts=[("x", "K", "K")])
    assert rows(own.select("cohort", "total")) == [("x", 1)]


def test_status_counts(spark):
    df = results(spark, ("A.java", "PASSED"), ("B.java", "FAILED"), ("C.java", "FAILED_TO_RUN"), ("D.java", "NOT_RUN"))
    assert rows(summary.status_counts(df)) == [(4, 1, 1, 1)]
    assert rows(summary.status_counts(df.where("false"))) == [(0, 0, 0, 0)]


def test_summary_lines(spark):
    df = results(spark, ("code/A.java", "PASSED"), ("F.java", "FAILED"), ("x.java", "FAILED_TO_RUN"))
    got = [r.line for r in reports.summary_lines(df, "n").orderBy("section", "seq").collect()]
    assert got == [
        "Test Execution Summary", "=====================", "",
        "Overall Results (All Files):", "---------------------------", "Total files tested: 3", "Passed: 1", "Failed: 1",
        "Failed to Run: 1", "",
        "Model Comparison Statistics (Letter Files Only):", "--------------------------------------------", "",
        "First Model Tests (A-E):", "------------------------", "Total tests: 1", "Passed: 1", "Failed/Failed to Run: 0",
        "Pass Rate: 100.00%",
        "Second Model Tests (F-J):", "------------------------", "Total tests: 1", "Passed: 0", "Failed/Failed to Run: 1",
        "Pass Rate: 0.00%",
        "Detailed Results:", "----------------", "✅ A.java: PASSED", "❌ F.java: FAILED", "⚠️ x.java: FAILED_TO_RUN",
    ]
    windows = [r.line for r in reports.summary_lines(df, "n", style="text").orderBy("section", "seq").collect()]
    assert windows[18:20] == ["Pass Rate: 100.00%", ""] and windows[-1] == "[FAILED_TO_RUN] x.java: FAILED_TO_RUN"


def test_java_report(spark):
    df = spark.createDataFrame(
        [("code/A.java", "PASSED", "out", None), ("B.java", "FAILED", "out", "bad")],
        "file_name string, status string, output string, error string",
    )
    got = reports.java_report(df, F.lit("NOW")).select("report_file", "report")
    assert rows(got) == [
        ("A.txt", "Test Results for A.java\nTimestamp: NOW\nStatus: PASSED\n\nTest Output:\nout"),
        ("B.txt", "Test Results for B.java\nTimestamp: NOW\nStatus: FAILED\n\nTest Output:\nout\nErrors:\nbad"),
    ]


def test_python_report(spark):
    df = spark.createDataFrame([("s/m.py", "\x1b[1mok\x1b[0m", "cov")], "script string, test_output string, coverage_output string")
    assert reports.python_report(df).first().report == (
        "Test Report for m\n" + "=" * 50 + "\n\nTEST RESULTS:\n" + "-" * 20 + "\nok\nCOVERAGE REPORT:\n" + "-" * 20 + "\ncov"
    )


@pytest.mark.parametrize("bits", [0, 2, 17, None])
def test_lag_and_prefix_sum(spark, bits):
    rng = random.Random(bits or 0)
    data = [
        (k, seq, rng.choice([None, -3, 0, 5])) for k in range(5) for seq in rng.sample(range(-50, 400), rng.randint(1, 60))
    ]
    df = spark.createDataFrame(data, "k int, seq int, v int")
    want_lag, want_sum = {}, {}
    for k in range(5):
        last, total = None, 0
        for _, seq, v in sorted(
            (d for d in data if d[0] == k), key=lambda d: d[1]
        ):
            want_lag[k, seq], want_sum[k, seq] = last, total
            last, total = v, total + (v or 0)
    got = ordered.lag_within(df, ["k"], "seq", "v", "p", bits).collect()
    assert {(r.k, r.seq): r.p for r in got} == want_lag
    got = ordered.sum_before(df, ["k"], "seq", "v", "p", bits).collect()
    assert {(r.k, r.seq): r.p for r in got} == want_sum


def test_newest(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 1, "w")], "k string, n int, v string")
    got = summary.last_writer_wins(df, ["k"], ["n"])
    assert rows(got) == [("a", 3, "z"), ("b", 1, "w")]


def test_history(spark):
    df = spark.createDataFrame([("a", 1, "P"), ("a", 2, "P"), ("a", 9, "F"), ("b", 5, "P")], "k string, n int, status string")
    assert rows(summary.log_history(df, ["k"], "n").select("k", "n", "previous_status", "changed")) == [
        ("a", 1, None, False), ("a", 2, "P", False), ("a", 9, "P", True), ("b", 5, None, False)
    ]
    assert rows(summary.log_totals(df, ["k"], "n")) == [("a", 3, 9, "F"), ("b", 1, 5, "P")]


IMPL = "task_id string, impl string, language string, path string, content string"
SUITE = "task_id string, language string, path string, content string"


def test_fan_out_and_layout_rules(spark):
    impls = spark.createDataFrame(
        [
            ("j", "A", "Java", "A.java", "public class A {}"),
            ("j", "B", "Java", "B.java", "public class B {} public class C {}"),
            ("j", "C", "Java", "C.java", "class C {}"),
            ("p", "solution", "Python", "p/solution.py", "x"),
            ("s", "a.js", "JavaScript", "s/a.js", "function f() {}"),
            ("s", "b.js", "JavaScript", "s/b.js", "function g() {}"),
            ("u", "a.js", "JavaScript", "u/a.js", "function f() {}"),
        ],
        IMPL,
    )
    suites = spark.createDataFrame(
        [
            ("j", "Java", "T.java", "t"),
            ("j", "Java", "S.java", "an earlier one"),
            ("s", "JavaScript", "index.test.js", "const { f } = require('./solution')"),
            ("u", "JavaScript", "index.test.js", "no import"),
            ("z", "Java", "T.java", "t"),
        ],
        SUITE,
    )
    assert rows(layout.fan_out(impls, suites).select("task_id", "impl", "test_path")) == [
        ("j", "A", "T.java"), ("j", "B", "T.java"), ("j", "C", "T.java"), ("p", "solution", None),
        ("s", "a.js", "index.test.js"), ("s", "b.js", "index.test.js"), ("u", "a.js", "index.test.js"),
    ]
    assert rows(layout.validate_layout(impls, suites).select("task_id", "impl", "rule")) == sorted(
        [
            ("j", "B", "many_public_classes"), ("j", "C", "no_public_class"), ("p", "solution", "reserved_file_name"),
            ("p", None, "no_test_file"), ("s", None, "exports_differ"), ("u", None, "no_require"), ("z", None, "no_code_files"),
        ],
        key=repr,
    )

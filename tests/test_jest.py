from __future__ import annotations

import pytest
from conftest import rows
from pyspark.sql import functions as F

from codetrials.operators import jest, reports

CASES = '[{"title":"a","status":"passed","failureMessages":[]},{"title":"b","status":"failed","failureMessages":["m1","m2"]}]'
HALF = f'{{"numPassedTests":1,"numTotalTests":2,"testResults":[{{"status":"failed","assertionResults":{CASES}}}]}}'
EQUAL = HALF.replace('"numPassedTests":1', '"numPassedTests":2')
EMPTY = '{"numPassedTests":0,"numTotalTests":0,"testResults":[{"status":"failed","assertionResults":[]}]}'
NO_COUNTS = '{"testResults":[{"status":"passed","assertionResults":[]}]}'


def outputs(spark, *pairs):
    data = [(i, "t", f"m{i}.js", rc, text) for i, (rc, text) in enumerate(pairs)]
    return spark.createDataFrame(data, "run_id int, task_id string, impl string, returncode int, stdout string")


def classify(spark, version, *pairs):
    got = jest.classify_jest(jest.parse_jest(outputs(spark, *pairs)), version)
    return [(r.status, r.passed, r.total) for r in sorted(got.collect(), key=lambda r: r.run_id)]


PAIRS = [
    (0, HALF), (0, EQUAL), (1, HALF), (1, EQUAL), (1, EMPTY), (0, EMPTY),
    (0, "{}"), (0, "junk"), (1, "{}"), (1, "junk"), (1, ""), (1, None), (0, ""),
    (1, "null"), (1, "[1]"), (1, HALF + " x"), (0, HALF + "\n"), (1, HALF + HALF), (1, "1}]"), (0, '{"testResults":[]}'),
    (0, NO_COUNTS),
]


def test_v2(spark):
    error = ("ERROR", 0, 0)
    assert classify(spark, "v2", *PAIRS) == [
        ("FAILED", 1, 2), ("PASSED", 2, 2), ("FAILED", 1, 2), ("PASSED", 2, 2), ("PASSED", 0, 0), ("PASSED", 0, 0),
        error, error, error, error, error, error, error,
        error, error, error, ("FAILED", 1, 2), error, error, error,
        ("PASSED", 0, 0),
    ]


def test_v1(spark):
    none = ("FAILED", 0, 0)
    error = ("ERROR", 0, 0)
    assert classify(spark, "v1", *PAIRS) == [
        ("FAILED", 1, 2), ("PASSED", 2, 2), ("FAILED", 1, 2), ("FAILED", 2, 2), none, ("PASSED", 0, 0),
        none, none, none, error, none, none, none,
        error, none, error, ("FAILED", 1, 2), error, error, none,
        ("PASSED", 0, 0),
    ]


def test_unknown_version(spark):
    with pytest.raises(ValueError):
        jest.classify_jest(jest.parse_jest(outputs(spark, (0, HALF))), "v3")


def test_summary_keeps_the_last_run(spark):
    df = jest.classify_jest(jest.parse_jest(outputs(spark, (0, HALF), (0, EQUAL), (0, "{}"))))
    same = df.withColumn("impl", F.when(F.col("run_id") < 2, "a").otherwise("b"))
    assert rows(jest.test_summary(same)) == [("t", "a", 2, 2, "PASSED"), ("t", "b", 0, 0, "ERROR")]


def test_cases(spark):
    got = jest.case_results(jest.parse_jest(outputs(spark, (0, HALF), (0, "{}"))), ["run_id"])
    assert rows(got) == [(0, 0, "a", "passed", ""), (0, 1, "b", "failed", "m1\nm2")]


def test_reports(spark):
    df = jest.classify_jest(jest.parse_jest(outputs(spark, (0, HALF), (0, "{}"))))
    report = reports.jest_report(df, F.lit("NOW")).collect()
    rule = "-" * 60
    assert [r.report for r in report] == [
        f"Test Run: NOW\n\n\n# Testing implementation: m0.js\n\n\n{rule}\n```bash\n✓ a\n✕ b\n\n● b\nm1\nm2\n```\n{rule}\n\n"
        "Test Suites: 1 failed\nTests:       1 passed, 1 failed, 2 total\n\n"
    ]
    console = reports.jest_console(df).first().console
    assert console == (
        "\x1b[32m✓\x1b[0m a\n\x1b[31m✕\x1b[0m b\n\x1b[31mm1\nm2\x1b[0m\n\nTest Suites: \x1b[31m1 failed\x1b[0m\n"
        "Tests:       1 passed, 1 failed, 2 total"
    )


def test_summary_lines(spark):
    df = jest.test_summary(jest.classify_jest(jest.parse_jest(outputs(spark, (0, HALF), (0, "{}")))))
    lines = [r.line for r in reports.jest_summary_lines(df).orderBy("task_id", "section", "seq").collect()]
    assert lines == [
        "Test Summary for t", "=" * 40, "",
        "m0.js               : 1/2 tests [FAILED]", "m1.js               : 0/0 tests [ERROR]",
    ]


def test_console_follows_the_exit_code(spark):
    df = outputs(spark, (0, HALF), (1, HALF), (1, "not json"), (0, "{}")).withColumn("stderr", F.lit("why"))
    shown = [r.console for r in reports.jest_console(jest.classify_jest(jest.parse_jest(df), "v1")).orderBy("impl").collect()]
    assert shown[0].endswith("2 total") and shown[1:] == ["\x1b[31mwhy\x1b[0m", "\x1b[31mFailed to run tests\x1b[0m", ""]


def test_report_of_a_suite_without_cases(spark):
    df = jest.classify_jest(jest.parse_jest(outputs(spark, (1, '{"numTotalTests": 1, "testResults": [{"status": "failed"}]}'))))
    report = reports.jest_report(df, F.lit("NOW")).first().report
    assert "```bash\n```" in report and "0 passed, 1 failed, 1 total" in report

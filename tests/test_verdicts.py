from __future__ import annotations

import datetime as dt

from conftest import plan, rows
from pyspark.sql import functions as F

from codetrials.operators import verdicts
from codetrials.plans import flows

RUNS = (
    "task_id string, impl string, phase string, returncode int, timed_out boolean, stdout string, stderr string, "
    "exception string, wrapper_failed boolean, ts timestamp_ntz"
)
T0, T1 = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 2)


def run(task, phase="run", rc=0, late=False, out="o", err="e", exc=None, wrap=False, ts=T0, impl="A"):
    return (task, impl, phase, rc, late, out, err, exc, wrap, ts)


def runs(spark, *records):
    return spark.createDataFrame(list(records), RUNS)


def test_compiled(spark):
    df = runs(
        spark,
        run("ce", "compile", 1), run("ce", rc=0),
        run("ok", "compile"), run("ok"),
        run("no", "compile"), run("no", rc=3, err=None),
        run("late", "compile"), run("late", rc=None, late=True),
        run("again", "compile", 1), run("again", "compile", 0, ts=T1), run("again", rc=1), run("again", rc=0, ts=T1, out="2"),
        run("bare", rc=0),
        run("only", "compile", 0),
    )
    assert rows(verdicts.classify_compiled(df).drop("impl")) == [
        ("again", "PASS", "2e"),
        ("bare", "PASS", "oe"),
        ("ce", "COMPILE ERROR", "e"),
        ("late", "TIMEOUT", "Execution timed out."),
        ("no", "FAIL", "o"),
        ("ok", "PASS", "oe"),
        ("only", None, None),
    ]


def test_time_limit_on_measured_duration(spark):
    df = runs(spark, run("a"), run("b")).withColumn("duration_s", F.when(F.col("task_id") == "a", 5.0).otherwise(5.1))
    assert rows(verdicts.classify_interpreted(df).select("task_id", "status")) == [("a", "PASS"), ("b", "TIMEOUT")]
    got = verdicts.classify_interpreted(df, limit_s=1.0).select("status").distinct()
    assert rows(got) == [("TIMEOUT",)]


def test_interpreted(spark):
    df = runs(spark, run("a"), run("b", rc=1), run("c", rc=None, late=True), run("d", "compile", 1))
    assert rows(verdicts.classify_interpreted(df).drop("impl")) == [
        ("a", "PASS", "oe"), ("b", "FAIL", "oe"), ("c", "TIMEOUT", "Execution timed out.")
    ]


def test_gradle(spark):
    df = runs(
        spark,
        run("a"),
        run("b", rc=0, out="x error: y"),
        run("c", rc=1, err="> Task :compileJava FAILED"),
        run("d", rc=2),
        run("e", exc="boom"),
        run("f", rc=9, out="", err="wrapper", wrap=True),
    )
    mac = rows(verdicts.classify_gradle(df).drop("impl"))
    assert mac == [
        ("a", "PASSED", "oe", None),
        ("b", "FAILED_TO_RUN", "x error: ye", "Compilation failed"),
        ("c", "FAILED_TO_RUN", "o> Task :compileJava FAILED", "Compilation failed"),
        ("d", "FAILED", "oe", "Tests failed with return code: 2"),
        ("e", "FAILED_TO_RUN", "", "boom"),
        ("f", "FAILED_TO_RUN", "", "Command '['gradle', 'wrapper']' returned non-zero exit status 9."),
    ]
    windows = rows(verdicts.classify_gradle(df, platform="windows").drop("impl"))
    assert windows[:5] == mac[:5]
    assert windows[5] == ("f", "FAILED", "wrapper", "Tests failed with return code: 9")


def test_build_gate(spark):
    df = runs(spark, run("a", "compile"), run("a"), run("b", "compile", 1), run("b"), run("c"))
    assert rows(verdicts.gate_on_build(df).select("task_id")) == [("a",)]
    assert rows(verdicts.skipped_by_build(df).select("task_id")) == [("b",), ("c",)]


def test_attach_verdicts(spark):
    tasks = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "task_id string, prompt string")
    judged = spark.createDataFrame(
        [("a", "ir", "PASS", " x \n", 1), ("a", "incs", "FAIL", " \n", 1), ("b", "ir", "FAIL", "", 1), ("b", "ir", "PASS", "new", 2)],
        "task_id string, variant string, status string, output string, n int",
    )
    attached = verdicts.attach_verdicts(tasks, judged, order="n")
    assert rows(attached.drop("prompt")) == [
        ("a", "PASS", "x", "FAIL", None), ("b", "PASS", "new", None, None), ("c", None, None, None, None)
    ]
    assert rows(verdicts.discriminating_tasks(attached).select("task_id")) == [("a",)]


def test_mixed_languages(spark):
    df = runs(spark, run("a", "compile", 1), run("a"), run("b", "compile", 1), run("b"), run("c"))
    languages = spark.createDataFrame([("a", "C++"), ("b", "Python")], "task_id string, language string")
    got = flows.judged_runs(df, languages, ["task_id", "impl"], "ts").select("task_id", "status")
    assert rows(got) == [("a", "COMPILE ERROR"), ("b", "PASS")]


def test_status_alone_agrees_and_reads_no_output(spark, folder):
    from codetrials.plans import derived

    runs = derived.runs(spark, folder)
    keys = ["task_id", "impl"]
    full = verdicts.classify_compiled(runs, keys, "run_id").select(*keys, "status")
    slim = verdicts.classify_compiled(runs, keys, "run_id", with_output=False)
    assert rows(slim) == rows(full)
    text = plan(slim)
    assert "SortAggregate" not in text and "stdout" not in text and "stderr" not in text


def test_last_build_counts(spark):
    df = spark.createDataFrame(
        [("a", 1, "compile", 0), ("a", 2, "compile", 1), ("a", 3, "run", 0), ("b", 1, "compile", 1), ("b", 2, "compile", 0), ("b", 3, "run", 0)],
        "task_id string, ts int, phase string, returncode int",
    )
    assert rows(verdicts.gate_on_build(df, ["task_id"]).select("task_id")) == [("b",)]
    assert rows(verdicts.skipped_by_build(df, ["task_id"]).select("task_id")) == [("a",)]


def test_judged_runs_aggregates_before_the_join(spark, folder):
    from codetrials.plans import queries

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(queries.all_queries()["judged_runs"](spark, folder))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = text[: text.index("SortMergeJoin")]
    assert "Aggregate" not in above and "partial_max" in text


def test_runs_of_unknown_tasks_are_kept_with_a_reason(spark):
    df = runs(spark, run("a"), run("b"), run("b"), run("c"), run("d"))
    languages = spark.createDataFrame([("a", "C++"), ("b", "Go"), ("d", None)], "task_id string, language string")
    got = flows.unjudged_runs(df, languages, ["task_id"])
    assert rows(got) == [("b", "unsupported language"), ("c", "unknown task"), ("d", "unsupported language")]

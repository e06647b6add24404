"""Figures, summaries and routes that read their input once, and plans without regexes from columns."""

from __future__ import annotations

import random
import re

from conftest import SMALL, plan, rows
from pyspark.sql import functions as F

from codetrials.operators import code, coverage, jest, layout, reports, summary
from codetrials.plans import derived, flows
from codetrials.plans.queries import all_queries
from codetrials.sources import readers, writers


def scans(df) -> int:
    return len(re.findall(r"FileScan|Scan parquet|LocalTableScan|Scan ExistingRDD|BatchScan", plan(df)))


def results(spark, n=200):
    draw = random.Random(4)
    rows_ = [(k, k % 7, draw.choice(["A.java", "b.java", "Zz.java", "K.java"]), draw.choice(["PASSED", "FAILED", "FAILED_TO_RUN", None])) for k in range(n)]
    return spark.createDataFrame(rows_, "n long, task_id long, file_name string, status string")


def test_summary_lines_read_their_results_once(spark):
    df = spark.read.parquet(f"{SMALL}/events.parquet").select(
        F.col("event_id").alias("n"), F.concat(F.char(65 + F.col("event_id") % 26), F.lit(".java")).alias("file_name"), F.lit("PASSED").alias("status")
    )
    lines = reports.summary_lines(df, "n")
    assert plan(lines).count("FileScan") == 1 and plan(lines).count("Expand") == 1


def test_summary_lines_keep_equal_files_and_empty_results(spark):
    df = results(spark)
    twice = df.unionByName(df)
    got = reports.summary_lines(twice, "n")
    assert got.where("section = 5").count() == 2 * df.count()
    assert rows(got.where("section < 5 and line like '%: %'")) != rows(reports.summary_lines(df, "n").where("section < 5 and line like '%: %'"))
    none = reports.summary_lines(df.limit(0), "n").orderBy("section", "seq").collect()
    assert [r.line for r in none if ": " in r.line][:4] == ["Total files tested: 0", "Passed: 0", "Failed: 0", "Failed to Run: 0"]
    assert [r.line for r in none if r.section == 5] == []


def test_all_figures_agree_with_each_by_itself(spark):
    df = results(spark)
    got = summary.all_figures(df)
    assert plan(got).count("Expand") == 1 and scans(got) == 1
    one = {(r.level, r.task_id, r.cohort): tuple(r)[3:7] for r in got.collect()}
    assert one["overall", None, None] == tuple(summary.status_counts(df).first())
    for r in summary.status_counts(df, ["task_id"]).collect():
        assert one["task", r.task_id, None] == tuple(r)[1:]
    for r in summary.cohort_stats(df).collect():
        total, passed, failed, broken = one.get(("cohort", None, r.cohort), (0, 0, 0, 0))
        assert (total, passed, failed + broken) == (r.total, r.passed, r.failed)


def test_layout_reads_every_file_once(spark):
    impls, suites = derived.java_impls(spark, SMALL), derived.tests(spark, SMALL)
    broken = layout.validate_layout(impls, suites)
    assert plan(broken).count("FileScan") == 2
    twice = layout.validate_layout(impls.unionByName(impls), suites)
    of_files = "impl is not null"
    assert twice.where(of_files).count() == 2 * broken.where(of_files).count()
    assert rows(twice.where("impl is null")) == rows(broken.where("impl is null"))


def test_records_are_checked_once_for_both_routes(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "bad"), (3, None)], "task_id long, reject_reason string")
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    counted = df.mapInArrow(count, df.schema)
    assert writers.write_routed(counted, str(tmp_path / "r")) == {"usable": 2, "rejected": 1}
    assert made.value == 3
    back = spark.read.parquet(str(tmp_path / "r"))
    assert rows(back.select("task_id", "outcome")) == [(1, "usable"), (2, "rejected"), (3, "usable")]
    assert writers.write_routed(df.limit(0), str(tmp_path / "none")) == {"usable": 0, "rejected": 0}


def test_no_query_has_a_regex_from_a_column(spark):
    text = plan(all_queries()["normalize_java"](spark, SMALL))
    for call in re.findall(r"regexp_replace\([^()]*(?:\([^()]*\)[^()]*)*\)|RLIKE\([^()]*\)", text):
        assert not re.search(r"regexp_replace\(\w+#\d+, \w+#\d+", call), call


def by_regex(text, name, target):
    out = re.sub(rf"{name}(?<!new {name})(?<!\w{name})(?!\w)", target, text)
    return out.replace(f"new {name}(", f"new {target}(")


def test_renaming_agrees_with_the_regex(spark):
    draw = random.Random(6)
    parts = ["Main", "MainA", "AMain", "new Main", "new Main(", "renew Main(", "(", " ", "\n", ".", "_", "é", "1", "MainMain", "new  Main(", "￿", "￿.", "￿;", "new MainMain("]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randrange(12))) for _ in range(3000)] + ["", "Main", "MainMain", "aa", "aaa"]
    for name, target in (("Main", "Solution"), ("aa", "b"), ("M", "Main")):
        df = spark.createDataFrame([(t, name, target) for t in texts], "t string, n string, to string")
        got = df.select("t", code.rename_class(F.col("t"), F.col("n"), F.col("to")).alias("out")).collect()
        for r in got:
            assert r.out == by_regex(r.t, name, target), (r.t, name)


def test_reports_with_escapes_of_their_own(spark):
    """Titles and messages with colours, the stand-in character, white space and check marks."""
    draw = random.Random(7)
    parts = ["t", " ", "\t", "\n", "✓", "✓  x ", "\x1b[31m", "\x1b", "\x9b1m", "0m", "[", "￿", "m", "●"]
    cases = []
    for k in range(600):
        own = parts if k % 2 else [p for p in parts if p not in ("\x1b[31m", "\x1b", "\x9b1m", "￿")]
        text = lambda own=own: "".join(draw.choice(own) for _ in range(draw.randrange(6)))
        cases.append([(text(), draw.choice(["passed", "failed"]), [text() for _ in range(draw.randrange(3))]) for _ in range(draw.randrange(4))])
    schema = "run_id long, impl string, passed int, total int, suite struct<status: string, assertionResults: array<struct<title: string, status: string, failureMessages: array<string>>>>"
    df = spark.createDataFrame([(k, f"m{k}", 1, 2, ("failed", c)) for k, c in enumerate(cases)], schema)
    got = {r.run_id: r.report for r in reports.jest_report(df, F.lit("T")).collect()}
    coloured = reports._lines(
        F.array(F.concat(F.lit("\n# Testing implementation: "), F.col("impl"))), "\n", reports.DIVISOR, "```bash", reports._cases(), "```", reports.DIVISOR,
        F.array(F.concat(F.lit("\n"), reports._suite_lines(F.lit(False), F.col("passed"), F.col("total"))[0])),
        F.array(reports._suite_lines(F.lit(False), F.col("passed"), F.col("total"))[1]),
    )
    from codetrials.functions import text as T

    want = {r.run_id: r.report for r in df.select("run_id", F.concat(F.lit("Test Run: T\n\n"), T.report_lines(F.array_join(coloured, "\n")), F.lit("\n\n")).alias("report")).collect()}
    assert got == want


def test_jest_summary_lines_are_no_distinct_over_lines(spark):
    text = plan(reports.jest_summary_lines(jest.test_summary(jest.classify_jest(jest.parse_jest(derived.jest(spark, SMALL))))))
    assert text.count("FileScan") == 1 and "Expand" in text
    assert not re.search(r"HashAggregate\(keys=\[[^\]]*line#", text)


def test_a_large_report_is_many_tasks_work(spark, tmp_path):
    head = "CLASS,PACKAGE,LINE_COVERED,LINE_MISSED,BRANCH_MISSED,BRANCH_COVERED,INSTRUCTION_COVERED,INSTRUCTION_MISSED"
    other = "LINE_MISSED,CLASS,PACKAGE,LINE_COVERED,BRANCH_MISSED,BRANCH_COVERED,INSTRUCTION_COVERED,INSTRUCTION_MISSED"
    (tmp_path / "run=1").mkdir()
    (tmp_path / "run=2").mkdir()
    (tmp_path / "run=1/r.csv").write_text(head + "\r\n" + "".join(f"C{k},p,{k},2,1,3,30,10\r\n" for k in range(20_000)))
    (tmp_path / "run=2/r.csv").write_text(other + "\n" + 'D,p,1,2,3,4,5,6\n"a\nb",p,1,2,3,4,5,6\n' + '5,"E, F",p,1,2,3,4,5\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        df = readers.read_jacoco(spark, str(tmp_path), "run")
        assert df.rdd.getNumPartitions() > 8 and "wholetext" not in plan(df).lower()
        one = df.where("report = 1")
        assert one.count() == 20_000 and one.agg(F.sum("line_covered")).first()[0] == sum(range(20_000))
        assert one.where("reject_reason is not null").count() == 0
        two = {r["class"]: (r.line_missed, r.reject_reason) for r in df.where("report = 2").collect() if r["class"]}
        assert two == {"p": (None, "counter is not an integer"), "E, F": (5, None)}
        assert df.where("report = 2 and reject_reason = 'quote left open'").count() == 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_notebooks_out_of_a_table(spark):
    good = '{"notebook": "n1", "nbformat": 4, "cells": [{"cell_type": "markdown", "source": ["### prompt"]}, {"cell_type": "markdown", "source": "x"}]}'
    df = spark.createDataFrame([(good, "a"), ("{ not json", "b"), ('{"nbformat": 3}', "c"), (None, "d"), ("[]", "e")], "value string, file string")
    books = readers.parse_notebooks(df, name="file")
    assert rows(books.select("notebook", "reject_reason")) == [("a", None)] + [(x, "not a version 4 notebook") for x in "bcde"]
    assert flows.records_of_notebooks(books).first().prompt == "x"
    assert readers.parse_notebooks(df).where("reject_reason is null").first().notebook == "n1"


def test_a_report_line_is_parsed_once_and_headers_need_no_sort_of_lines(spark, tmp_path, monkeypatch):
    head = "CLASS,PACKAGE,LINE_COVERED,LINE_MISSED,BRANCH_MISSED,BRANCH_COVERED,INSTRUCTION_COVERED,INSTRUCTION_MISSED"
    odd = ["a,b", "a,b", "1,2", ",x", "1,2,3"]  # no known name in the first line
    late = ["CLASS,PACKAGE", head, "A,p"]  # a later line looks more like a header
    for run, lines in enumerate([[head, "A,p,1,2,3,4,5,6", '"A, ""B""",p,1,2,3,4,5,6', ",p,1,2,3,4,5,6", "A,p,x,2,3,4,5,6", head], odd, late], 1):
        (tmp_path / f"run={run}").mkdir()
        (tmp_path / f"run={run}/r.csv").write_text("\n".join(lines) + "\n")
    made = []
    kept = readers.scratch_path
    monkeypatch.setattr(readers, "scratch_path", lambda *a: made.append(kept(*a)) or made[-1])
    df = readers.read_jacoco(spark, str(tmp_path), "run")
    integer, length = "counter is not an integer", "line and header differ in length"
    assert rows(df.where("report = 1").select("class", "line_covered", "reject_reason")) == sorted(
        [("A", 1, None), ('A, "B"', 1, None), (None, None, length), ("A", None, integer)], key=repr
    )
    assert rows(df.where("report = 2").select("class", "reject_reason")) == sorted([(None, integer), (None, length), (None, length)], key=repr)
    assert rows(df.where("report = 3").select("class", "reject_reason")) == sorted([("A", integer), (None, length)], key=repr)
    assert sorted(r.head for p in made for r in spark.read.parquet(p).where("head is not null").collect()) == sorted([head, odd[0], late[0]])
    for found in (coverage.rejected_reports(df, ["report"]), coverage.jacoco_totals(df, ["report"])):
        assert plan(found).count("regexp_extract_all") <= 3  # of the lines, beside those of the headers
    first = spark.read.text(str(tmp_path)).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), F.lit(1).alias("at"))
    assert "SortAggregate" not in plan(readers._line_groups(first))

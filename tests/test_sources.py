from __future__ import annotations

import json

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from codetrials.operators import coverage, notebooks, reports, tasks
from codetrials.plans import flows
from codetrials.schemas import TASKS
from codetrials.sources import files, readers, writers


def put(root, name, text):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def cell(kind, source):
    return {"cell_type": kind, "source": source, "metadata": {}}


BOOK = {
    "nbformat": 4,
    "nbformat_minor": 5,
    "metadata": {},
    "cells": [
        cell("markdown", ["### prompt\n"]),
        cell("code", "x"),
        cell("markdown", ["a\n", "b"]),
        cell("markdown", "### test"),
        cell("markdown", '["x"]'),
        cell("markdown", []),
    ],
}


def test_notebook_files(spark, tmp_path):
    put(tmp_path, "one book.ipynb", json.dumps(BOOK, indent=1))
    put(tmp_path, "sub/old.ipynb", json.dumps({"nbformat": 3, "worksheets": []}))
    put(tmp_path, "broken.ipynb", "{ not json")
    put(tmp_path, "list.ipynb", "[]")
    put(tmp_path, "other.json", json.dumps(BOOK))
    books = readers.read_notebooks(spark, str(tmp_path))
    reasons = {r.notebook.rsplit("/", 1)[1]: r.reject_reason for r in books.collect()}
    assert reasons.pop("one%20book.ipynb") is None
    assert set(reasons) <= {"old.ipynb", "broken.ipynb", "list.ipynb"} and {"old.ipynb", "broken.ipynb"} <= set(reasons)
    assert set(reasons.values()) == {"not a version 4 notebook"}
    got = rows(readers.notebook_cells(books).select("pos", "cell_type", "source"))
    assert got == [
        (0, "markdown", "### prompt\n"), (1, "code", "x"), (2, "markdown", "a\nb"), (3, "markdown", "### test"),
        (4, "markdown", '["x"]'), (5, "markdown", ""),
    ]
    record = flows.records_of_notebooks(books).first()
    assert (record.prompt, record.test) == ("a\nb", '["x"]')
    cells = notebooks.extract_fields(readers.notebook_cells(books))
    assert rows(cells.select("field", "value")) == [("prompt", "a\nb"), ("test", '["x"]')]


def test_missing_notebooks_are_empty(spark, tmp_path):
    books = readers.read_notebooks(spark, str(tmp_path / "none"))
    assert books.collect() == [] and readers.notebook_cells(books).collect() == []


def test_packed_notebooks(spark, tmp_path):
    put(tmp_path, "part.json", json.dumps({"notebook": "n1", **BOOK}) + "\n" + json.dumps({"notebook": "n2", "nbformat": 3}) + "\n")
    books = readers.read_notebooks(spark, str(tmp_path), packed=True)
    assert rows(books.select("notebook", "reject_reason")) == [("n1", None), ("n2", "not a version 4 notebook")]
    assert readers.notebook_cells(books).count() == 6


def test_tasks_as_array_object_and_lines(spark, tmp_path):
    put(tmp_path, "array.json", json.dumps([{"task_id": "1", "test": ["a", "b"]}, {"task_id": "2", "test": "['c']", "extra": 1}], indent=4))
    put(tmp_path, "object.json", json.dumps({"task_id": "3", "test": [1]}))
    got = tasks.decode_tests(readers.read_tasks(spark, str(tmp_path)), listed="test_list")
    assert rows(got.select("task_id", "tests")) == [("1", ["a", "b"]), ("2", ["c"]), ("3", None)]


def test_task_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("1", "p\n\"é\"", None), ("2", None, "x")], "task_id string, prompt string, domain string")
    writers.write_tasks(df, str(tmp_path / "t"))
    assert rows(writers.task_json(df)) == [('{"task_id":"1","prompt":"p\\n\\"é\\""}',), ('{"task_id":"2","domain":"x"}',)]
    back = readers.read_tasks(spark, str(tmp_path / "t"), multi_line=False)
    assert rows(back.select("task_id", "prompt", "domain")) == rows(df)
    assert back.columns == [*TASKS.names, "test_list"]


TREE = {
    "java": (
        ["t 1/code/A.java", "t 1/code/sub/B.java", "t 1/code/build/C.java", "t 1/code/rebuild/D.java", "t 1/code/.gradle2/E.java",
         "t 1/test/SolutionTest.java", "t 1/code/x.txt", "t2/code/A.java.java", "rebuild/code/F.java"],
        [("rebuild", "F"), ("t 1", "A"), ("t 1", "B"), ("t2", "A")],
        ["t 1"],
    ),
    "python": (
        ["a/m.py", "a/test.py", "a/solution.py", "a/sub/n.py", "a/v1.2.py", "b/m.txt", "a+b/m.py"],
        [("a", "m"), ("a", "v1.2"), ("a+b", "m")],
        ["a"],
    ),
    "js": (
        ["a/model_A.js", "a/index.test.js", "a/solution.js", "a/alt/x.js", "a/b.test.js"],
        [("a", "b.test.js"), ("a", "model_A.js")],
        ["a"],
    ),
    "js_v1": (
        ["a/base_code.js", "a/solution.js", "a/index.test.js", "a/alternate_responses/m.js.js", "a/other.js", "b/solution.js"],
        [("a", "base_code"), ("a", "m.js"), ("a", "solution"), ("b", "solution")],
        ["a"],
    ),
    "cpp": (
        ["tasks/7/src/A.cpp", "tasks/7/src/ideal.cpp", "tasks/7/src/x.h", "tasks/7/tests/test_model.cpp", "tasks/8/src/A.cpp"],
        [("7", "A"), ("7", "ideal"), ("8", "A")],
        ["7"],
    ),
}


@pytest.mark.parametrize("layout", sorted(TREE))
def test_file_scans(spark, tmp_path, layout):
    names, impls, suites = TREE[layout]
    root = tmp_path / "build corpus"  # the root's own name does not count
    for name in names:
        put(root, name, f"text of {name}\n")
    found = files.scan_impl_files(spark, str(root), layout)
    assert rows(found.select("task_id", "impl")) == impls
    assert rows(files.scan_test_files(spark, str(root), layout).select("task_id")) == [(s,) for s in suites]
    for r in found.collect():
        assert r.content == f"text of {r.path}\n" and r.language == files.LAYOUTS[layout].language
    one = files.scan_impl_files(spark, str(root), layout, task_id=impls[0][0])
    assert rows(one.select("task_id", "impl")) == [i for i in impls if i[0] == impls[0][0]]


def test_missing_folder_is_empty(spark, tmp_path):
    assert files.scan_impl_files(spark, str(tmp_path / "none"), "js").collect() == []


def test_cpp_target(spark):
    assert spark.range(1).select(files.cpp_target(F.lit("ideal"))).first()[0] == "ideal_tests"
    impls = spark.createDataFrame([("A",), ("D",), ("ideal",), ("a",)], "impl string")
    assert rows(files.fixed_targets(impls)) == [("A",), ("ideal",)]


def test_metadata(spark, tmp_path):
    put(tmp_path, "t1/metadata.json", '{\n "programming_language": "JavaScript",\n "difficulty": ""\n}')
    got = files.read_task_metadata(spark, str(tmp_path)).first()
    assert (got.task_id, got.programming_language, got.difficulty, got.user_prompt) == ("t1", "JavaScript", "", None)


def test_jacoco_by_name_not_position(spark, tmp_path):
    head = "GROUP,PACKAGE,CLASS,LINE_COVERED,LINE_MISSED,BRANCH_MISSED,BRANCH_COVERED,INSTRUCTION_COVERED,INSTRUCTION_MISSED,COMPLEXITY_MISSED"
    put(tmp_path, "run=1/r.csv", f"{head}\ng,p,A,8,2,1,3,30,10,5\ng,p,B,x,2,1,3,30,10,5\n")
    df = readers.read_jacoco(spark, str(tmp_path), "run")
    good = df.where("reject_reason is null").first()
    assert (good.report, good["class"], good.line_covered, good.line_missed, good.branch_covered) == ("1", "A", 8, 2, 3)
    assert rows(df.where("reject_reason is not null").select("class")) == [("B",)]
    by_path = readers.read_jacoco(spark, str(tmp_path / "run=1"))
    assert by_path.first().report.endswith("run=1/r.csv")


def test_programs_and_reports_and_logs(spark, tmp_path):
    programs = spark.createDataFrame(
        [("1", "Python", "ir", "ir.py", "a\nb"), ("2", "C++", "incs", "incs.cpp", "c")],
        "task_id string, language string, variant string, file_name string, source string",
    )
    writers.write_programs(programs, str(tmp_path / "p"))
    assert rows(spark.read.parquet(str(tmp_path / "p")).select(*programs.columns)) == rows(programs)

    texts = spark.createDataFrame([("1", "A", "x\ny"), ("1", "B", None)], "task_id string, impl string, report string")
    writers.write_reports(texts, str(tmp_path / "r"))
    assert rows(spark.read.parquet(str(tmp_path / "r"))) == [("1", "A", "x\ny"), ("1", "B", None)]
    writers.write_reports(texts, str(tmp_path / "f"), layout="files")
    part = next((tmp_path / "f" / "task_id=1" / "impl=A").glob("part-*"))
    assert part.read_text() == "x\ny\n"
    empty = next((tmp_path / "f" / "task_id=1" / "impl=B").glob("part-*"))
    assert empty.read_text() == "\n"

    one = spark.createDataFrame([("A_tests", "l1")], "target string, line string")
    writers.append_logs(one, str(tmp_path / "l"))
    writers.append_logs(one, str(tmp_path / "l"))
    assert spark.read.parquet(str(tmp_path / "l")).count() == 2
    writers.append_logs(spark.createDataFrame([("B_tests", "l2")], one.schema), str(tmp_path / "l"), fresh=True)
    writers.append_logs(one, str(tmp_path / "l"), fresh=True)
    assert rows(spark.read.parquet(str(tmp_path / "l")).select("target", "line")) == [("A_tests", "l1"), ("B_tests", "l2")]


def test_line_files_are_in_order_over_many_parts(spark, tmp_path):
    lines = spark.range(0, 5000, 1, 8).select(
        F.lit(5).alias("section"), (4999 - F.col("id")).alias("seq"), F.concat(F.lit("line "), 4999 - F.col("id")).alias("line")
    )
    with_parts = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        writers.write_summary(lines, str(tmp_path / "s"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", with_parts)
    parts = sorted((tmp_path / "s").glob("part-*"))
    assert len(parts) > 1
    assert "".join(p.read_text() for p in parts) == "".join(f"line {i}\n" for i in range(5000))
    text = plan(reports.collect_reports(lines, ["section"], "seq"))
    assert "rangepartitioning" in text and "collect_list" not in text


def test_coverage_file(spark, tmp_path):
    overall = spark.createDataFrame([(50.0, 25.0, 0.0, 50.0)], "overall_coverage double, instruction_coverage double, branch_coverage double, line_coverage double")
    writers.write_coverage(reports.coverage_lines(overall, F.lit("NOW")), str(tmp_path / "c"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "c").glob("part-*")))
    assert text == (
        "Code Coverage Report\n===================\n\nGenerated: NOW\n\nOverall Coverage Metrics:\n------------------------\n"
        "Overall Coverage: 50.00%\nTotal Instruction Coverage: 25.00%\nTotal Branch Coverage: 0.00%\nTotal Line Coverage: 50.00%\n\n"
    )


def test_jacoco_reports_of_two_column_orders(spark, tmp_path):
    one = "GROUP,PACKAGE,CLASS,LINE_COVERED,LINE_MISSED,BRANCH_MISSED,BRANCH_COVERED,INSTRUCTION_COVERED,INSTRUCTION_MISSED"
    two = "INSTRUCTION_MISSED,LINE_COVERED,CLASS,PACKAGE,GROUP,LINE_MISSED,BRANCH_MISSED,BRANCH_COVERED,INSTRUCTION_COVERED"
    put(tmp_path, "run=1/r.csv", f'{one}\ng,p,"A<X, Y>",8,2,1,3,30,10\n')
    put(tmp_path, "run=2/r.csv", f"{two}\r\n10,6,B,p,g,4,0,0,20\r\n")
    put(tmp_path, "run=3/r.csv", f"{one}\ng,p,C,8,2,1,3,30,10\ng,p,D,x,2,1,3,30,10\ng,p,E\n")
    df = readers.read_jacoco(spark, str(tmp_path), "run")
    assert rows(df.where("report < '3'").select("class", "line_covered", "line_missed", "instruction_missed")) == [
        ("A<X, Y>", 8, 2, 10), ("B", 6, 4, 10),
    ]
    totals = coverage.jacoco_totals(df.withColumnRenamed("report", "run"), ["run"])
    assert rows(totals.select("run", "covered_lines", "total_lines")) == [("1", 8, 10), ("2", 6, 10)]
    assert rows(coverage.rejected_reports(df.withColumnRenamed("report", "run"), ["run"]).select("run", "rejected_rows")) == [("3", 2)]
    assert readers.read_jacoco(spark, str(tmp_path / "none")).count() == 0


def test_hidden_names_are_rows_with_a_reason(spark, tmp_path):
    for name in ("7/m.py", "7/_helper.py", "7/__init__.py", "7/.b.py", "8/test.py"):
        put(tmp_path, f"code/x/code/{name}", "pass")
    put(tmp_path, "jav/3/code/sub/_A.java", "class A {}")
    put(tmp_path, "jav/3/code/B.java", "class B {}")
    found = files.scan_impl_files(spark, str(tmp_path / "code/x/code"), "python")
    assert rows(found.select("path", "content")) == [
        ("7/.b.py", None), ("7/__init__.py", None), ("7/_helper.py", None), ("7/m.py", "pass"),
    ]
    assert found.where("content is null and reject_reason is null").count() == 0
    java = files.scan_impl_files(spark, str(tmp_path / "jav"), "java")
    assert rows(java.select("path", "content")) == [("3/code/B.java", "class B {}"), ("3/code/sub/_A.java", None)]


def test_roots_with_spaces_relative_and_named_twice(spark, tmp_path, monkeypatch):
    put(tmp_path, "w/code/a b+c/code/7/m.py", "pass")
    got = files.scan_impl_files(spark, str(tmp_path / "w/code/a b+c/code"), "python")
    assert rows(got.select("path", "content")) == [("7/m.py", "pass")]


def test_appended_logs_have_few_files_per_target(spark, tmp_path):
    logs = spark.range(0, 4000, 1, 8).select(F.concat(F.lit("t"), F.col("id") % 3).alias("target"), F.col("id").alias("line"))
    writers.append_logs(logs, str(tmp_path / "many"), salts=2)
    for target in range(3):
        assert len(list((tmp_path / "many" / f"target=t{target}").glob("part-*"))) <= 2
    assert spark.read.parquet(str(tmp_path / "many")).count() == 4000

from __future__ import annotations

import ast
import json
import random

from conftest import rows
from pyspark.sql import functions as F

from codetrials.operators import render, tasks
from codetrials.plans import flows
from codetrials.schemas import TASKS

RECORD = {
    "task_id": "t1",
    "prompt": "  def f(x):\n",
    "canonical_solution": "    return x\n      # two",
    "incorrect_solution": "    return 0",
    "entry_point": "Sol:f",
    "test": '["assert f(1) == 1", " assert f(2) == 2 "]',
    "language": "Python",
}


def frame(spark, *records):
    return spark.createDataFrame([{f.name: r.get(f.name) for f in TASKS} for r in records], TASKS)


def literal(text):
    """What the field means, read by Python."""
    try:
        value = ast.literal_eval(text)
    except Exception:
        return None
    if not isinstance(value, list | tuple) or not all(isinstance(v, str) for v in value):
        return None
    try:
        json.dumps(value).encode()
        "".join(value).encode("utf-8")
    except UnicodeEncodeError:
        return None
    return list(value)


def decode(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, test string")
    return [r.tests for r in sorted(tasks.decode_tests(df).select("i", "tests").collect())]


def test_decode_golden(spark):
    texts = [
        r"['it\'s']", r'["a\nb"]', "['a',]", "('a','b')", r"['\x41']", "[]", " ['a' 'b', \"c\"]", "[1]", "['a', None]",
        "'abc'", "{'a'}", "oops", "", r"['\/', '\q']", r"['😀']", '["\\u0041"]', "['a\tb']", "[['a']]",
        "[true]", "['a'] x", "\n['a']", "['say \"hi\"']",
    ]
    got = decode(spark, texts)
    assert got[:5] == [["it's"], ["a\nb"], ["a"], ["a", "b"], ["A"]]
    assert got == [literal(t) for t in texts]


def test_decode_agrees_with_python_on_random_literals(spark):
    rng = random.Random(3)
    pieces = ["'", '"', "\\", "n", "x41", "u0041", "a", ",", " ", "[", "]", "é", "\n", "\\'", '\\"', "t"]
    texts = []
    for _ in range(1500):
        body = ", ".join(
            q + "".join(rng.choice(pieces) for _ in range(rng.randint(0, 4))) + q
            for q in rng.choices(["'", '"'], k=rng.randint(0, 3))
        )
        texts.append(f"[{body}]")
    texts += [repr([s]) for s in texts[:300]]
    assert decode(spark, texts) == [literal(t) for t in texts]


def test_null_and_listed_tests(spark):
    df = spark.createDataFrame(
        [(1, None, ["a"]), (2, None, None), (3, "['b']", None), (4, None, ["a", None])],
        "i int, test string, test_list array<string>",
    )
    got = tasks.decode_tests(df, listed="test_list").select("i", "tests")
    assert [r.tests for r in sorted(got.collect(), key=lambda r: r.i)] == [["a"], None, ["b"], None]


def test_routing_is_exact(spark):
    df = frame(spark, *[{**RECORD, "task_id": x, "language": x} for x in ("Python", "python", "Go", "C++")], {"task_id": "n"})
    assert rows(tasks.route_language(df).select("language")) == [("C++",), ("Python",)]
    assert rows(tasks.skipped_language(df).select("task_id")) == [("Go",), ("n",), ("python",)]


def test_quarantine_reasons(spark):
    df = frame(
        spark,
        RECORD,
        {**RECORD, "task_id": "go", "language": "Go", "prompt": None},
        {**RECORD, "task_id": "np", "prompt": None},
        {**RECORD, "task_id": "bad", "test": "[1]"},
        {**RECORD, "task_id": "je", "language": "Java", "entry_point": None},
        {**RECORD, "task_id": "pe", "entry_point": None},
    )
    checked = flows.checked_tasks(df)
    assert rows(tasks.usable(checked).select("task_id")) == [("pe",), ("t1",)]
    assert rows(tasks.quarantined(checked).select("task_id", "reject_reason")) == [
        ("bad", "unreadable test"), ("go", "unsupported language"), ("je", "missing entry_point"), ("np", "missing prompt")
    ]


def test_variants(spark):
    got = tasks.explode_variants(frame(spark, RECORD)).select("task_id", "variant", "solution")
    assert rows(got) == [("t1", "incs", "    return 0"), ("t1", "ir", "    return x\n      # two")]


def rendered(spark, language, **changes):
    df = tasks.decode_tests(frame(spark, {**RECORD, "language": language, **changes}))
    one = {r.variant: r for r in render.render(df, language).collect()}
    both = {r.variant: r for r in render.render_all(df).collect()}
    assert one == both
    return one


def test_render_python(spark):
    got = rendered(spark, "Python")
    assert got["ir"].file_name == "ir.py"
    assert got["ir"].source == (
        "def f(x):\n    return x\n      # two\n\n# Tests\nassert f(1) == 1\n assert f(2) == 2 "
    )
    assert rendered(spark, "Python", test="[]")["incs"].source == "def f(x):\n    return 0\n\n# Tests"


def test_render_cpp(spark):
    assert rendered(spark, "C++")["ir"].source == (
        "#include <iostream>\n#include <cassert>\nusing namespace std;\n\ndef f(x):\nreturn x\n  # two\n\n"
        "int main() {\n    assert f(1) == 1\n    assert f(2) == 2\n"
        '    cout << "All tests passed.\\n";\n    return 0;\n}'
    )


def test_render_java(spark):
    got = rendered(spark, "Java")
    assert got["ir"].file_name == "Sol.java" and got["incs"].file_name == "Sol.java"
    # The text is stripped before it is dedented, so the second line keeps its margin.
    assert got["ir"].source == (
        "def f(x):\n    return x\n          # two\n\n    public static void main(String[] args) {\n"
        "        assert f(1) == 1\n        assert f(2) == 2\n"
        '        System.out.println("All tests passed.");\n    }\n}'
    )
    empty = rendered(spark, "Java", canonical_solution=" \n ")["ir"].source
    assert empty.startswith("def f(x):\n\n    public static void main")


def test_render_js(spark):
    assert rendered(spark, "JavaScript")["ir"].source == (
        "const assert = require('assert');\n\ndef f(x):\nreturn x\n      # two\n\n// Tests\n"
        'assert f(1) == 1\n assert f(2) == 2 \nconsole.log("All tests passed.");'
    )


def test_missing_parts_give_no_program(spark):
    assert rendered(spark, "C++", prompt=None)["ir"].source is None
    assert rendered(spark, "C++", test="oops")["ir"].source is None
    assert rendered(spark, "C++", canonical_solution=None)["ir"].source is None


def test_union_languages(spark):
    a, b = spark.range(1).withColumn("x", F.lit(1)), spark.range(2)
    assert tasks.union_languages(a, b).count() == 3

"""Text helpers against Python's own functions."""

from __future__ import annotations

import os
import random
import re
import textwrap

from pyspark.sql import functions as F

from codetrials.functions import text as T

ALPHABET = " \t\n\n  ab\r\x0b\x1c\x1f\x85 \xa0x\\$"


def samples(n=3000, longest=25):
    rng = random.Random(7)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def apply(spark, values, *exprs):
    df = spark.createDataFrame(list(enumerate(values)), "i int, s string")
    got = df.select("i", *[e.alias(f"c{k}") for k, e in enumerate(exprs)]).collect()
    return [tuple(r)[1:] for r in sorted(got)]


def test_dedent_indent_strip_lines_match_python(spark):
    values = samples()
    got = apply(spark, values, T.py_dedent("s"), T.py_indent("s", 4), T.py_strip("s"), T.py_lines("s"))
    want = [
        (textwrap.dedent(s), textwrap.indent(s, "    "), s.strip(), "\n".join(s.splitlines())) for s in values
    ]
    assert got == want


def test_dedent_of_indented_text(spark):
    values = ["    a\n    b", "    a\n      b\n\n   \n    c", "\ta\n\t b", "\ta\n    b", ""]
    got = apply(spark, values, T.py_dedent("s"), T.py_dedent(T.py_strip("s")))
    assert got[0] == ("a\nb", "a\n    b")
    assert got == [(textwrap.dedent(s), textwrap.dedent(s.strip())) for s in values]


def test_strip_ansi_py(spark):
    pattern = re.compile(r"\x1B(?:[@-Z\\-_]|\[[0-?]*[ -/]*[@-~])")
    values = ["\x1b[1;32mok\x1b[0m", "\x1bM up", "a\x1b[2Kb\x1b[?25lc", "\x1b", "plain [0m"]
    assert apply(spark, values, T.strip_ansi("s")) == [(pattern.sub("", s),) for s in values]


def test_strip_ansi_js(spark):
    values = ["\x1b[31m✕\x1b[0m t", "\x9b31mx", "\x1b[K|", "\x1b[12;3|y", "\x1b(B"]
    assert apply(spark, values, T.strip_ansi("s", "js")) == [("✕ t",), ("x",), ("|",), ("y",), ("",)]


def test_report_lines(spark):
    values = ["  \x1b[32m✓\x1b[0m   passes  \n\t\n x ﻿", "✓", "✓a \x1b[0m ", "a ✓"]
    got = apply(spark, values, T.report_lines("s"))
    assert got == [("✓ passes\n\nx",), ("✓ ",), ("✓ a",), ("a ✓",)]


def test_drop_lines(spark):
    values = ["/u/x\na\n/u/y\nb", "a\n/u/x", "/u/", "a /u/x\n", "\n/u/z\n\n"]
    got = apply(spark, values, T.drop_lines("s", "/u/"))
    assert got == [("a\nb",), ("a\n",), ("",), ("a /u/x\n",), ("\n\n",)]


def test_file_stems(spark):
    values = ["p/A.java", "A.java.java", "x/a.b.py", ".hidden", "..a", "m.js.js", "x..y", "n.cpp"]
    got = apply(spark, values, *[T.file_stem("s", f) for f in ("java", "python", "js", "dir", "cpp")])
    for s, (java, python, js, first, cpp) in zip(values, got, strict=True):
        name = os.path.basename(s)
        assert java == name.split(".java")[0]
        assert python == os.path.splitext(name)[0]
        assert js == name.replace(".js", "", 1)
        assert first == name.split(".")[0]
        assert cpp == name.removesuffix(".cpp")


def test_pad_end_keeps_long_values(spark):
    values = ["ab", "x" * 25, "\U0001f600"]
    assert apply(spark, values, T.pad_end("s", 20)) == [
        ("ab" + " " * 18,), ("x" * 25,), ("\U0001f600" + " " * 18,)
    ]


def test_pct2_rounds_like_python(spark):
    values = [0.125, 2.675, 0.005, 100.0, 0.0] + [k / 1000 for k in range(0, 100000, 35)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    got = [r[1] for r in sorted(df.select("i", T.pct2("v")).collect())]
    assert got == [f"{v:.2f}%" for v in values]


def test_small_helpers(spark):
    values = ["Cls:run:x", "Cls", " \t\xa0", ":x"]
    assert apply(spark, values, T.entry_class("s"), T.null_if_blank("s")) == [
        ("Cls", "Cls:run:x"), ("Cls", "Cls"), (" \t\xa0", None), ("", ":x")
    ]
    icons = apply(spark, ["PASSED", "FAILED", "NOT_RUN"], T.status_icon("s"), T.status_icon("s", "text"))
    assert icons == [("✅", "[PASS]"), ("❌", "[FAIL]"), ("⚠️", "[FAILED_TO_RUN]")]


def test_let_evaluates_once(spark):
    got = spark.range(1).select(T.let(F.rand(), lambda x: x - x).alias("d")).first().d
    assert got == 0.0

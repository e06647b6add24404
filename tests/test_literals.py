"""Lists of string literals against Python's own reading."""

from __future__ import annotations

import ast
import random
import warnings

from conftest import plan
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codetrials.functions import literals
from codetrials.operators import tasks

FRAGMENTS = [
    "'a'", '"b"', "[", "]", "(", ")", ",", ",", " ", "\n", "\t", "\\\n", "#c\n", "'''x\ny'''", '"""q"""', "r'\\n'", "u'z'", "b'y'", "f'w'", "'\\x41'",
    "'\\101'", "'\\u00e9'", "'\\U0001F600'", "'\\ud800'", "'it\\'s'", "'\\q'", "''", "1", "None", "\f", "'\\\n'", "'é😀'", '"\\""', "'\\777'", "'\\x4'",
    "\r\n", "\r", "'''a'b''c'''", "R'''\\'''", "'", '"', "\\", "'\\U00110000'", "'\\8'", "'\\0'", "\x0b", "\xa0",
]
FIXED = [
    "['a']", "('a',)", "()", "[]", "(())", "([])", "('a')", "'a','b'", "'a',", "(('a'),'b')", "['a' 'b']", "['a','b',]", "[,]", "['a'['b']]", "\n['a']",
    "\n ['a']", "['a']\n", "['a']\n 'b'", " \t['a']", "['a'] # c", "['a']\\\n", "['a',\\\n'b']", "'a',\\\n'b'", "'a',\n'b'", "\\\n['a']", "\x00['a']",
    "[('a')]", "[('a','b')]", "((('a',)))", "('a' # x\n,)", "[]\n\n", "'a' 'b'", "('a')('b')", "['a']('b')", "[ 'a' ('b') ]", "", "[", "('a',]", "['a'),",
    "(),", "((),'a')", "(),()", "'''a''' \"b\",", "\f['a']", "\n\f['a']", " \f ['a']", "['a']\n ", "['a']\n  # c\n  ", "'a',\n\t\n", "['a']\n\x0c",
    "{'a'}", "['a', *['b']]", "[x for x in 'a']", "['a' if 1 else 'b']", "'a'.b", "['a'][0]", "('a' 'b',)", "# c\n['a']", "\n\n# c\n ['a']", "['a'];",
    "'" + "a" * 20_000 + "',", "[" + "'\\n'," * 5_000 + "]", "(" * 100 + "['a']" + ")" * 100,
]


def by_python(text):
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            value = ast.literal_eval(text)
        if not isinstance(value, (list, tuple)) or not all(isinstance(v, str) for v in value):
            return None
        for v in value:
            v.encode()
        return list(value)
    except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
        return None


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.v for r in df.select("i", literals.string_list(F.col("t")).alias("v")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == by_python(text), text


def test_as_python_reads_them(spark):
    draw = random.Random(5)
    items = ["'a'", '"b" \'c\'', "('d')", "r'\\d'", "'''e\n'''", "'\\x41\\n'", "\n 'f'", "'g' # h\n", "(('i'\n'j'))"]
    texts = [*FIXED, *["".join(draw.choice(FRAGMENTS) for _ in range(draw.randrange(1, 9))) for _ in range(6000)]]
    for _ in range(6000):
        inner = ",".join(draw.choice(items) for _ in range(draw.randrange(0, 6)))
        texts.append(draw.choice(["[", "(", "", "(["]) + inner + draw.choice(["", ",", "\n", " "]) + draw.choice(["]", ")", "", "])"]))
    check(spark, texts)
    assert sum(by_python(t) is not None for t in texts) > 1000


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.text(max_size=30), max_size=4), min_size=1, max_size=40))
def test_what_python_writes(spark, lists):
    texts = [repr(x) for x in lists] + [repr(tuple(x)) for x in lists] + [ascii(x) for x in lists] + ["".join(map(repr, x)) for x in lists]
    check(spark, texts)


def test_escapes_by_name_are_left_out_or_read_by_a_worker(spark):
    df = spark.createDataFrame([(1, "['\\N{BULLET}']"), (2, "('a',)"), (3, "['\\N{NO SUCH}']"), (4, None)], "i long, test string")
    jvm = tasks.decode_tests(df)
    assert {r.i: r.tests for r in jvm.collect()} == {1: None, 2: ["a"], 3: None, 4: None}
    assert "Python" not in plan(jvm)
    assert {r.i: r.tests for r in tasks.decode_tests(df, by_name=True).collect()} == {1: ["•"], 2: ["a"], 3: None, 4: None}

"""Main functions out of tables of lines: the row-local form, for every way to cut a file into runs."""

from __future__ import annotations

import random
import re

import pytest
from conftest import plan
from pyspark.sql import functions as F

from codetrials.operators import code, main_lines

POOL = [
    "int main()", "int main() {", "\tint main (int a) { return 0; }", "int main(){}", "{", "}", "  {", "}}", "{{", "x", "  } else {", "int mains()",
    "a{b}c", "}{", "  }", "", "/* int main() */ }",
]


def texts():
    draw = random.Random(5)
    out = ["\n".join(draw.choice(POOL) for _ in range(draw.randrange(0, 45))) for _ in range(300)]
    deep = ["int main()", *["{"] * 70, *["x"] * 9, *["}"] * 69, "inside", "}", "after"]
    negative = ["int main() {", *["}"] * 20, *["{"] * 21, "}", "after", "}"]
    return [*out, "", "int main()", "\n".join(deep), "\n".join(negative), "\n".join([*deep, *negative] * 3)]


def lines_of(text):
    return (text if not text or text.endswith("\n") else text + "\n").split("\n")[:-1]


@pytest.mark.parametrize("mode", main_lines.MODES)
def test_same_lines_as_the_row_local_form(spark, mode):
    files = list(enumerate(texts()))
    whole = spark.createDataFrame(files, "f long, content string").select("f", code.without_main(F.col("content"), mode).alias("content"))
    want = {r.f: r.content for r in whole.collect()}
    rows = [(k, 7 * i - 20, line) for k, text in files for i, line in enumerate(lines_of(text))]  # positions with gaps, from below 0
    lines = spark.createDataFrame(rows, "f long, pos long, line string").repartition(4).cache()
    for bits in (None, 0, 3, 4, 5, 30):
        got = dict.fromkeys(want, "")
        for r in sorted(main_lines.remove_main_lines(lines, ["f"], mode=mode, bits=bits).collect()):
            got[r.f] += r.line + "\n"
        assert got == want, bits


def test_one_large_file_is_many_tasks_work(spark):
    n = F.col("id")
    line = F.when(n == 1000, "int main()").when(n == 1001, "{").when((n > 1001) & (n < 190_000) & (n % 2 == 0), "  {").when((n > 1001) & (n < 190_000), "  }")
    lines = spark.range(0, 200_000, 1, 4).select(F.concat(F.lit("f"), n * 0).alias("f"), n.alias("pos"), F.when(n == 195_000, "}").otherwise(F.coalesce(line, F.lit("x"))).alias("line"))
    kept = main_lines.remove_main_lines(lines, ["f"], bits=12)
    assert kept.agg(F.count("*"), F.min("pos"), F.max("pos")).first()[0] == 1000 + 4999
    assert kept.where("pos between 1000 and 195000").count() == 0
    text = plan(kept)
    assert re.search(r"hashpartitioning\((f#\d+, )?_run#", text)


def test_unknown_mode(spark):
    with pytest.raises(ValueError):
        main_lines.remove_main_lines(spark.createDataFrame([], "f long, pos long, line string"), ["f"], mode="x")

"""Test programs from task records: one source text per task and solution variant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import entry_class, py_dedent, py_indent, py_lines, py_strip
from codetrials.operators.tasks import explode_variants
from codetrials.schemas import LANGUAGES

# The text around prompt, solution and tests in each language.
CPP_HEAD = "#include <iostream>\n#include <cassert>\nusing namespace std;\n"
CPP_MAIN = "\nint main() {"
CPP_TAIL = '    cout << "All tests passed.\\n";\n    return 0;\n}'
PYTHON_TESTS = "\n# Tests"
JAVA_MAIN = "\n    public static void main(String[] args) {"
JAVA_TAIL = '        System.out.println("All tests passed.");\n    }\n}'
JS_HEAD = "const assert = require('assert');\n"
JS_TESTS = "// Tests"
JS_TAIL = 'console.log("All tests passed.");'

SUFFIX = {"Python": ".py", "C++": ".cpp", "Java": ".java", "JavaScript": ".js"}


def _join(*parts: Column) -> Column:
    """Join single texts and arrays of texts by line ends; an empty array adds no line, a NULL part gives NULL."""
    return F.array_join(F.concat(*parts), "\n")


def _line(value: Column | str) -> Column:
    return F.array(F.lit(value) if isinstance(value, str) else value)


def _guard(text: Column) -> Column:
    needed = F.col("prompt").isNotNull() & F.col("solution").isNotNull()
    return F.when(needed, text)


def cpp_source() -> Column:
    return _guard(
        _join(
            _line(CPP_HEAD),
            _line(py_strip("prompt")),
            _line(py_dedent("solution")),
            _line(CPP_MAIN),
            F.transform("tests", lambda t: F.concat(F.lit("    "), py_strip(t))),
            _line(CPP_TAIL),
        )
    )


def python_source() -> Column:
    return _guard(
        _join(
            _line(py_strip("prompt")),
            _line(py_indent(py_dedent("solution"), 4)),
            _line(PYTHON_TESTS),
            F.col("tests"),
        )
    )


def java_source() -> Column:
    body = py_lines(py_indent(py_dedent(py_strip("solution")), 4))
    return _guard(
        _join(
            _line(py_strip("prompt")),
            F.filter(F.array(body), lambda b: b != ""),  # an empty body has no line at all
            _line(JAVA_MAIN),
            F.transform("tests", lambda t: F.concat(F.lit("        "), py_strip(t))),
            _line(JAVA_TAIL),
        )
    )


def js_source() -> Column:
    return _guard(
        _join(
            _line(JS_HEAD),
            _line(py_strip("prompt")),
            _line(F.concat(py_dedent(py_strip("solution")), F.lit("\n"))),
            _line(JS_TESTS),
            F.col("tests"),
            _line(JS_TAIL),
        )
    )


SOURCES = {"Python": python_source, "C++": cpp_source, "Java": java_source, "JavaScript": js_source}


def render(tasks: DataFrame, language: str) -> DataFrame:
    """Decoded tasks (with ``tests``) of one language -> ``(task_id, language, variant, file_name, source)``."""
    return _render(tasks.where(F.col("language") == language), SOURCES[language]())


def render_all(tasks: DataFrame) -> DataFrame:
    """The same for all languages in a single pass over the tasks."""
    source = F.lit(None).cast("string")
    for language in LANGUAGES:
        source = F.when(F.col("language") == language, SOURCES[language]()).otherwise(source)
    return _render(tasks.where(F.col("language").isin(LANGUAGES)), source)


def _render(tasks: DataFrame, source: Column) -> DataFrame:
    suffix = F.element_at(F.create_map(*[F.lit(x) for kv in SUFFIX.items() for x in kv]), F.col("language"))
    stem = F.when(F.col("language") == "Java", entry_class("entry_point")).otherwise(F.col("variant"))
    return explode_variants(tasks).select(
        "task_id", "language", "variant", F.concat(stem, suffix).alias("file_name"), source.alias("source")
    )

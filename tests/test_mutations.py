"""The golden tests must notice a wrong rule: each one has to fail on a version that breaks it on purpose."""

from __future__ import annotations

import pytest
import test_code
import test_jest
import test_notebooks
import test_results
import test_tasks
import test_text
import test_verdicts
from pyspark.sql import functions as F

from codetrials.functions import text
from codetrials.operators import code, coverage, jest, notebooks, render, summary, tasks, verdicts

# (module, name, wrong version, test that must fail, its arguments after the session)
MUTANTS = {
    "placeholders disarm": (notebooks, "PLACEHOLDER_MARK", "# Nothing", test_notebooks.test_golden, (0,)),
    "code cells count": (notebooks, "is_step", lambda kind, source: ~source.startswith("# Put"), test_notebooks.test_golden, (1,)),
    "any header arms": (notebooks, "TASK_FIELDS", [*notebooks.TASK_FIELDS[:-1], "Notes"], test_notebooks.test_golden, (3,)),
    "strip only blanks": (notebooks, "py_strip", F.trim, test_notebooks.test_golden, (6,)),
    "no dedent": (render, "py_dedent", lambda c: F.col(c) if isinstance(c, str) else c, test_tasks.test_render_python, ()),
    "dedent before strip": (render, "py_strip", lambda c: c if not isinstance(c, str) else F.trim(c), test_tasks.test_render_java, ()),
    "indent of blank lines too": (text, "PY_BLANK_CLASS", r"\x00", test_text.test_dedent_indent_strip_lines_match_python, ()),
    "pad cuts": (text, "pad_end", lambda c, n: F.rpad(c, n, " "), test_text.test_pad_end_keeps_long_values, ()),
    "half-up percentages": (text, "pct2", lambda c: F.format_string("%.2f%%", F.col(c)), test_text.test_pct2_rounds_like_python, ()),
    "escapes read as JSON": (tasks, "PLAIN_LIST", r"(?s).*", test_tasks.test_decode_golden, ()),
    "languages without case": (tasks, "LANGUAGES", [*tasks.LANGUAGES, "python"], test_tasks.test_routing_is_exact, ()),
    "private functions exported": (code, "JS_FUNCTION", code.JS_FUNCTION.replace("[a-zA-Z$]", "[a-zA-Z_$]"), test_code.test_exports_golden, ()),
    "depth ignored": (code, "brace_balance", lambda line: F.lit(0), test_code.test_exports_golden, ()),
    "all braces counted": (code, "_exit_line", lambda lines, balanced, real=code._exit_line: real(lines, True), test_code.test_remove_main_golden, ()),
    "new X<> renamed": (code, "rename_class", lambda c, n, t: F.regexp_replace(c, F.concat(F.lit(r"\b"), n, F.lit(r"\b")), t), test_code.test_normalize_java, ()),
    "every import rewritten": (code, "JS_IMPORT_ANY", code.JS_IMPORT_ONE, test_code.test_rewrite_import, ()),
    "stdout without stderr": (verdicts, "_text", lambda name: F.coalesce(F.col(name if name == "stdout" else "exception"), F.lit("")), test_verdicts.test_compiled, ()),
    "timeout counts as failure": (verdicts, "_late", lambda runs, limit: F.lit(False), test_verdicts.test_interpreted, ()),
    "trailing text is JSON": (jest, "_is_json", lambda t: F.try_parse_json(t).isNotNull(), test_jest.test_v2, ()),
    "framework classes counted": (coverage, "FRAMEWORK_PREFIXES", [], test_results.test_jacoco_totals, ()),
    "long names have cohorts": (summary, "is_letter_file", lambda name: F.lit(True), test_results.test_cohorts, ()),
}


@pytest.mark.parametrize("name", sorted(MUTANTS))
def test_mutant_is_noticed(spark, monkeypatch, name):
    module, attribute, wrong, test, arguments = MUTANTS[name]
    monkeypatch.setattr(module, attribute, wrong)
    with pytest.raises(AssertionError):
        test(spark, *arguments)

"""Implementations and their test suites: pairing and layout rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import base_name
from codetrials.operators.code import exported_names, has_public_class, import_head, last_suites


def fan_out(impl_files: DataFrame, test_files: DataFrame) -> DataFrame:
    """Every implementation with its task's one suite, NULL where there is none.

    An equi-join with one suite row per key, the last one by path.  There is no broadcast hint, since the suites grow with the tasks; a
    task with very many implementations is split by the adaptive skew join.
    """
    suites = last_suites(test_files, ("task_id", "language")).select(
        "task_id", "language", F.col("path").alias("test_path"), F.col("content").alias("test_content")
    )
    return impl_files.join(suites, ["task_id", "language"], "left")


def validate_layout(impl_files: DataFrame, test_files: DataFrame) -> DataFrame:
    """Broken rules as ``(task_id, language, impl, rule)``; ``impl`` is NULL for a rule about the whole task.

    Every file is read once: it becomes a row of flags for its task and a row for each rule it breaks itself.  One
    aggregation combines the flags, before its shuffle, and counts the broken rules, which come out as often as they went
    in; rules about a task (a side that is missing, exports that differ) are told from its flags.
    """
    content = F.col("content")
    java, script = F.col("language") == "Java", F.col("language") == "JavaScript"
    nothing = F.lit(None).cast("string")
    file_rules = F.array(
        F.when(java & (F.regexp_count(content, F.lit("public class")) > 1), "many_public_classes"),
        F.when(java & (~has_public_class(content)), "no_public_class"),
        F.when((F.col("language") == "Python") & (base_name("path") == "solution.py"), "reserved_file_name"),
    )

    def row(impl: Column, rule: Column, code: Column, test: Column, exports: Column, bare: Column) -> Column:
        names = ("impl", "rule", "code", "test", "exports", "bare")
        return F.struct(*[c.alias(n) for n, c in zip(names, (impl, rule, code, test, exports, bare), strict=True)])

    no, yes = F.lit(False), F.lit(True)
    exports = F.when(script, F.array_join(exported_names(content), ","))
    flags = F.array(row(nothing, nothing, yes, no, exports, no))
    broken = F.transform(F.array_compact(file_rules), lambda r: row(F.col("impl"), r, no, no, nothing, no))
    code = impl_files.select("task_id", "language", F.explode(F.concat(flags, broken)).alias("f")).select("task_id", "language", "f.*")
    bare = script & import_head(content).isNull()
    tests = test_files.select("task_id", "language", F.explode(F.array(row(nothing, nothing, no, yes, nothing, bare))).alias("f"))
    combined = (
        code.unionByName(tests.select("task_id", "language", "f.*"))
        .groupBy("task_id", "language", "impl", "rule")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.bool_or("code").alias("code"),
            F.bool_or("test").alias("test"),
            F.bool_or("bare").alias("bare"),
            F.min("exports").alias("first"),
            F.max("exports").alias("last"),
        )
    )
    task_rules = F.array_compact(
        F.array(
            F.when(~F.col("test"), "no_test_file"),
            F.when(~F.col("code"), "no_code_files"),
            F.when(F.col("bare"), "no_require"),
            F.when(F.col("first") != F.col("last"), "exports_differ"),
        )
    )
    rules = F.when(F.col("rule").isNull(), task_rules).otherwise(F.array_repeat("rule", F.col("n").cast("int")))
    return combined.select("task_id", "language", "impl", F.explode(rules).alias("rule"))

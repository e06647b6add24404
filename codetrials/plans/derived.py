"""Tables of the data model derived from general-purpose tables (orders, events, documents, conversations).

Every function takes ``(spark, folder)`` and returns a DataFrame whose size follows its source table.  All of them are
projections of their source, except :func:`tasks`, which joins question and answer turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _letter(n: Column, count: int) -> Column:
    return F.char(F.lit(65) + n % count)


def notebook_cells(spark: SparkSession, folder: str) -> DataFrame:
    """``(notebook, pos, cell_type, source)``: two or three cells per conversation turn."""
    turns = table(spark, folder, "conversations").select(
        "*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")
    )
    k, turn = F.col("k"), F.col("turn")
    field = (
        F.when(turn % 4 == 0, "task_id")
        .when(turn % 4 == 1, "prompt")
        .when(turn % 4 == 2, "canonical_solution")
        .otherwise("not_a_field")
    )
    return turns.where(~((k == 2) & (turn % 3 != 1))).select(
        F.col("conv_id").alias("notebook"),
        (turn * 3 + k).alias("pos"),
        F.when((k == 1) & (F.col("role") == "system"), "code").otherwise("markdown").alias("cell_type"),
        F.when(k == 0, F.concat(F.lit("### "), field))
        .when((k == 1) & (turn % 3 == 1), "# Put your text here")
        .otherwise(F.col("text"))
        .alias("source"),
    )


def _json_text(value: Column) -> Column:
    """A JSON string literal."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def packed_notebooks(spark: SparkSession, folder: str) -> DataFrame:
    """Notebook files as JSON text, one per document: a header cell before every third line, every second source
    stored as a list."""

    def cells(line: Column, i: Column) -> Column:
        text = F.when(
            i % 2 == 0, F.to_json(F.array(line, F.lit("\n"), F.lit("end")))
        ).otherwise(_json_text(line))
        kind = F.when(i % 5 == 4, "code").otherwise("markdown")
        body = F.concat(F.lit('{"cell_type":"'), kind, F.lit('","source":'), text, F.lit("}"))
        field = F.when(i % 2 == 0, "prompt").otherwise("test")
        head = F.concat(F.lit('{"cell_type":"markdown","source":"### '), field, F.lit('"}'))
        return F.when(i % 3 == 0, F.array(head, body)).otherwise(F.array(body))

    lines = F.split("text", "\n", -1)
    listed = F.array_join(F.flatten(F.transform(lines, cells)), ",")
    return table(spark, folder, "documents").select(
        F.concat(
            F.lit('{"notebook":"nb'), F.col("doc_id"), F.lit('","nbformat":'),
            F.when(F.col("doc_id") % 50 == 49, "3").otherwise("4"), F.lit(',"cells":['), listed, F.lit("]}"),
        ).alias("value")
    )


def tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Task records: a user turn as the prompt, the assistant turn after it as solution and tests."""
    turns = table(spark, folder, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("question"), (F.col("turn") + 1).alias("next")
    )
    given = turns.where(F.col("role") == "assistant").select(
        "conv_id", F.col("turn").alias("next"), F.col("text").alias("answer")
    )
    conv = F.col("conv_id")
    language = (
        F.when(conv % 5 == 0, "Python")
        .when(conv % 5 == 1, "C++")
        .when(conv % 5 == 2, "Java")
        .when(conv % 5 == 3, "JavaScript")
        .otherwise("Go")
    )
    breaks = F.replace(F.col("answer"), F.lit("\n"), F.lit("\n      "))
    return asked.join(given, ["conv_id", "next"]).select(
        (conv * 100 + F.col("turn")).alias("task_id"),
        language.alias("language"),
        F.concat(F.lit("  "), "question", F.lit("  ")).alias("prompt"),
        F.concat(F.lit("    "), breaks).alias("canonical_solution"),
        F.concat(F.lit("wrong "), "answer").alias("incorrect_solution"),
        F.concat(F.lit("Cls"), conv, F.lit(":run")).alias("entry_point"),
        F.concat(F.lit('["'), F.replace(F.col("answer"), F.lit("\n"), F.lit('","')), F.lit('"]')).alias("test"),
    )


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Process outcomes: a compile and a run row per event."""
    events = table(spark, folder, "events").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    k, kind, number = F.col("k"), F.col("event_type"), F.col("event_id")
    code = F.when(k == 0, F.when(kind == "error", 1).otherwise(0)).otherwise(
        F.when(kind == "view", 1).when(kind == "signup", F.lit(None)).otherwise(0)
    )
    return events.select(
        number.alias("run_id"),
        (number % 100).alias("task_id"),
        _letter(number, 26).alias("impl"),
        "ts",
        F.when(k == 0, "compile").otherwise("run").alias("phase"),
        code.cast("int").alias("returncode"),
        ((k == 1) & (kind == "signup")).alias("timed_out"),
        F.concat(F.lit("out "), number.cast("string")).alias("stdout"),
        F.when(number % 7 == 0, F.concat(F.lit("x.cpp:1: error: "), kind)).otherwise("").alias("stderr"),
    )


def variant_of_run() -> Column:
    """Which solution variant a run belongs to."""
    return F.when(F.floor(F.col("run_id") / 100) % 2 == 0, "ir").otherwise("incs")


def jacoco(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage counters per order line."""
    supplier = F.col("l_suppkey")
    prefix = F.when(supplier % 10 == 0, "org.junit.C").when(supplier % 10 == 1, "org.mockito.C").otherwise("app.C")
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        F.concat(prefix, F.col("l_partkey").cast("string")).alias("class"),
        F.col("l_quantity").cast("bigint").alias("line_covered"),
        (F.lit(50) - F.col("l_quantity")).cast("bigint").alias("line_missed"),
        (F.col("l_discount") * 100).cast("bigint").alias("branch_covered"),
        F.col("l_linenumber").cast("bigint").alias("branch_missed"),
        (F.col("l_quantity") * 3).cast("bigint").alias("instruction_covered"),
        (F.col("l_linenumber") * 2).cast("bigint").alias("instruction_missed"),
    )


def jacoco_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Coverage reports as files write them: upper-case names, more columns, another order, some bad counters."""
    flags = table(spark, folder, "lineitem")
    supplier = F.col("l_suppkey")
    prefix = F.when(supplier % 10 == 0, "org.junit.C").otherwise("app.C")
    return flags.select(
        F.concat("l_returnflag", "l_linestatus").alias("run"),
        F.lit("g").alias("GROUP"),
        F.lit("p").alias("PACKAGE"),
        F.concat(prefix, F.col("l_partkey")).alias("CLASS"),
        (F.col("l_linenumber") * 2).cast("string").alias("INSTRUCTION_MISSED"),
        (F.col("l_quantity") * 3).cast("bigint").cast("string").alias("INSTRUCTION_COVERED"),
        F.when(F.col("l_partkey") % 50 == 0, "n/a").otherwise(F.col("l_linenumber").cast("string")).alias("BRANCH_MISSED"),
        F.col("l_linenumber").cast("string").alias("BRANCH_COVERED"),
        (F.lit(50) - F.col("l_quantity")).cast("bigint").cast("string").alias("LINE_MISSED"),
        F.col("l_quantity").cast("bigint").cast("string").alias("LINE_COVERED"),
        F.lit("0").alias("COMPLEXITY_MISSED"),
    )


def jacoco_reports(spark: SparkSession, folder: str, odd: bool) -> DataFrame:
    """Coverage reports of 50 runs, those of odd runs in another column order; every seventh report has bad counters."""
    run = F.col("l_orderkey") % 50
    prefix = F.when(F.col("l_suppkey") % 10 == 0, "org.junit.C").otherwise("app.C")
    bad = (run % 7 == 3) & (F.col("l_linenumber") == 1)
    rows = table(spark, folder, "lineitem").where(run % 2 == int(odd)).select(
        run.alias("run"),
        F.lit("g").alias("GROUP"),
        F.lit("p").alias("PACKAGE"),
        F.concat(prefix, F.col("l_partkey")).alias("CLASS"),
        F.when(bad, "n/a").otherwise((F.col("l_linenumber") * 2).cast("string")).alias("INSTRUCTION_MISSED"),
        (F.col("l_quantity") * 3).cast("bigint").cast("string").alias("INSTRUCTION_COVERED"),
        F.col("l_linenumber").cast("string").alias("BRANCH_MISSED"),
        F.lit("1").alias("BRANCH_COVERED"),
        (F.lit(50) - F.col("l_quantity")).cast("bigint").cast("string").alias("LINE_MISSED"),
        F.col("l_quantity").cast("bigint").cast("string").alias("LINE_COVERED"),
    )
    return rows.select("run", *reversed(rows.columns[1:])) if odd else rows


def cohort_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """``(cohort, low, high)``: overlapping ranges of run numbers, a cohort per supplier; some hold nothing."""
    number = F.col("s_suppkey")
    low = number * 37 % 900
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("c"), number).alias("cohort"), low.alias("low"), (low + (number % 10) * (number % 17) - 5).alias("high")
    )


def more_tests(spark: SparkSession, folder: str) -> DataFrame:
    """The Java suites, and for every second task one before and one after it by path."""
    own = tests(spark, folder)
    other = own.where(F.col("task_id") % 2 == 0)
    first = other.withColumns({"path": F.lit("test/ATest.java"), "content": F.concat(F.lit("class MainTest "), "content")})
    first = first.withColumn("content", F.replace("content", F.lit("Solution"), F.lit("Other")))
    last = other.withColumns({"path": F.lit("test/ZTest.java"), "content": F.lit("class ZTest {}")})
    return own.unionByName(first).unionByName(last)


JEST_NONE = '{"numPassedTests":0,"numTotalTests":0,"testResults":[{"status":"failed","assertionResults":[]}]}'
JEST_HALF = (
    '{"numPassedTests":1,"numTotalTests":2,"testResults":[{"status":"failed","assertionResults":['
    '{"title":"t1","status":"passed","failureMessages":[]},'
    '{"title":"t2","status":"failed","failureMessages":["e',
    '","f"]}]}]}',
)
JEST_FULL = (
    '{"numPassedTests":2,"numTotalTests":2,"testResults":[{"status":"passed","assertionResults":['
    '{"title":"t1","status":"passed","failureMessages":[]},'
    '{"title":"t2","status":"passed","failureMessages":[]}]}]}'
)


def jest(spark: SparkSession, folder: str) -> DataFrame:
    """Jest output text per event."""
    number, kind = F.col("event_id"), F.col("event_type")
    return table(spark, folder, "events").select(
        (number % 100).alias("task_id"),
        number.alias("run_id"),
        F.when(kind.isin("click", "error", "view"), 1).otherwise(0).alias("returncode"),
        F.concat(F.lit("model"), (F.floor(number / 100) % 5).cast("string")).alias("impl"),
        F.when(kind == "signup", "{}")
        .when(kind == "view", "not json")
        .when(kind == "error", JEST_NONE)
        .when(kind == "click", F.concat(F.lit(JEST_HALF[0]), number.cast("string"), F.lit(JEST_HALF[1])))
        .otherwise(JEST_FULL)
        .alias("stdout"),
        F.when(kind.isin("click", "view"), F.concat(F.lit("failed in run "), number.cast("string"))).alias("stderr"),
    )


def js_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of JavaScript-like files, one file per user; the event number orders the lines."""
    number, kind = F.col("event_id"), F.col("event_type")
    name = F.concat(F.when(number % 2 == 0, "_p").otherwise("g"), number.cast("string"))
    return table(spark, folder, "events").select(
        F.col("user_id").alias("file_id"),
        number.alias("pos"),
        F.when(kind == "signup", F.concat(F.lit("function f"), number.cast("string"), F.lit("(a) {")))
        .when(kind == "view", F.concat(F.lit("async function "), name, F.lit("() { return {")))
        .when(kind == "error", "}")
        .when(kind == "purchase", "} }")
        .otherwise("  return 1;")
        .alias("line"),
    )


def _impls(docs: DataFrame, language: str, folder: str, suffix: str, content: Column) -> DataFrame:
    impl = _letter(F.col("doc_id"), 10)
    return docs.select(
        F.floor(F.col("doc_id") / 10).cast("bigint").alias("task_id"),
        impl.alias("impl"),
        F.lit(language).alias("language"),
        F.concat(F.lit(folder), impl, F.lit(suffix)).alias("path"),
        content.alias("content"),
    )


def impls(spark: SparkSession, folder: str) -> DataFrame:
    """Plain texts as Java implementations, ten per task."""
    return _impls(table(spark, folder, "documents"), "Java", "code/", ".java", F.col("text"))


def tests(spark: SparkSession, folder: str) -> DataFrame:
    """A Java suite per benchmark item."""
    number = F.col("item_id")
    head = F.when(number % 2 == 0, "class SolutionTest ").otherwise("class MainTest ")
    return table(spark, folder, "benchmark").select(
        number.alias("task_id"),
        F.lit("Java").alias("language"),
        F.lit("test/SolutionTest.java").alias("path"),
        F.concat(head, "text").alias("content"),
    )


def java_impls(spark: SparkSession, folder: str) -> DataFrame:
    """Java-like files: members of all access levels, an inner class first in some, no public class in others; the
    class name also stands all over the text."""
    number = F.col("doc_id")
    name = F.concat(F.lit("Main"), _letter(number, 26))
    text = F.replace(F.col("text"), F.lit(" the "), F.concat(F.lit(" private "), name, F.lit(" ")))
    text = F.replace(text, F.lit(" of "), F.concat(F.lit(" new "), name, F.lit("() ")))
    text = F.replace(text, F.lit(" and "), F.concat(F.lit(" new "), name, F.lit("<>() ")))
    content = F.concat(
        F.when(number % 5 == 0, "private class Inner {}\n").otherwise(""),
        F.when(number % 7 == 0, "class ").otherwise("public class "), name,
        F.lit(" {\n private  static int x;\n protected final static int y;\n protected int z;\n// "), text, F.lit("\n}"),
    )
    return _impls(table(spark, folder, "documents"), "Java", "code/", ".java", content)


def js_impls(spark: SparkSession, folder: str) -> DataFrame:
    """JavaScript-like files: functions at several brace depths, some private, some with an export statement."""
    text = F.regexp_replace("text", r"\. ([A-Za-z]+) ", ".\nfunction $1 (a) {\n}\n")
    text = F.replace(text, F.lit("function T"), F.lit("async function _T"))
    text = F.replace(F.replace(text, F.lit(" of "), F.lit(" { ")), F.lit(" and "), F.lit(" } "))
    tail = F.when(F.col("doc_id") % 3 == 0, "\nmodule.exports = { old,\n older };\n").otherwise("  \n")
    content = F.concat(F.lit("  function first() {}\nfunction top() {\n}\n"), text, tail)
    return _impls(table(spark, folder, "documents"), "JavaScript", "./alternate_responses/", ".js", content)


def js_tests(spark: SparkSession, folder: str) -> DataFrame:
    """A JavaScript suite per benchmark item, with either import style or none; the import is there twice."""
    number = F.col("item_id")
    names = F.concat(F.lit("const {  fn"), number, F.lit(" } = require('./solution')"))
    one = F.concat(F.lit("const Cls"), number, F.lit('  = require("./solution.js")'))
    statement = F.when(number % 3 == 0, names).when(number % 3 == 1, one).otherwise("import x")
    return table(spark, folder, "benchmark").select(
        number.alias("task_id"),
        F.lit("JavaScript").alias("language"),
        F.lit("index.test.js").alias("path"),
        F.concat("text", F.lit("\n"), statement, F.lit(";\n"), statement, F.lit(";\n")).alias("content"),
    )


def cpp_impls(spark: SparkSession, folder: str) -> DataFrame:
    """C++-like files with a main function in several brace styles in the middle."""
    number = F.col("doc_id")
    head = (
        F.when(number % 4 == 0, "int main()\n{\n")
        .when(number % 4 == 1, "int main() {\n")
        .when(number % 4 == 2, "int  main(int a, char** b)\n{\n  {\n")
        .otherwise("int mains()\n{\n")
    )
    text = F.replace(F.replace(F.col("text"), F.lit(". "), F.lit(";\n")), F.lit(" of "), F.lit("\n}\n"))
    text = F.replace(text, F.lit(" and "), F.lit("\n\tint main (void)\n{\n"))
    content = F.concat(F.lit("int f() {\n return 1;\n}\n"), head, text, F.lit("\n}\nint g() {\n}"))
    return _impls(table(spark, folder, "documents"), "C++", "src/", ".cpp", content)


def cpp_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The C++-like files as lines."""
    return cpp_impls(spark, folder).select("task_id", "impl", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line"))


def cpp_amalgam(spark: SparkSession, folder: str) -> DataFrame:
    """``(lang, pos, line)``: the same files one after the other as one large file for each language of the texts."""
    docs = table(spark, folder, "documents")
    number = F.col("task_id") * 10 + F.ascii("impl") - 65
    langs = docs.select(F.col("doc_id").alias("_doc"), F.coalesce("lang", F.lit("none")).alias("lang"))
    lines = cpp_lines(spark, folder).withColumn("_doc", number.cast("bigint")).join(langs, "_doc")
    return lines.select("lang", (F.shiftleft("_doc", 20) + F.col("pos")).alias("pos"), "line")


def source_tree(spark: SparkSession, folder: str, layout: str, hidden: bool = False) -> DataFrame:
    """``(path, content)`` of a code corpus in the folder layout of a runner, with files that must be left out.  With
    ``hidden``, some names begin with ``_`` or ``.``."""
    number = F.col("doc_id")
    task = F.floor(number / 10).cast("string")
    letter = _letter(number, 10)
    kind = number % 10
    if layout == "java":
        inner = F.when(kind == 1, "rebuild/").when(kind == 2, ".gradle/").when(kind == 3, "sub/").otherwise("")
        path = F.concat(task, F.when(kind == 4, "/test/").otherwise("/code/"), inner, letter, F.lit(".java"))
    elif layout == "python":
        name = F.when(kind == 1, "test").when(kind == 2, "solution").otherwise(letter)
        path = F.concat(task, F.when(kind == 3, "/sub/").otherwise("/"), name, F.lit(".py"))
    elif layout == "js":
        name = F.when(kind == 1, "index.test").when(kind == 2, "solution").otherwise(letter)
        path = F.concat(task, F.when(kind == 3, "/sub/").otherwise("/"), name, F.lit(".js"))
    elif layout == "js_v1":
        name = F.when(kind == 1, "base_code").when(kind == 2, "solution").otherwise(F.concat(letter, F.lit(".js.x")))
        path = F.concat(task, F.when(kind > 3, "/alternate_responses/").otherwise("/"), name, F.lit(".js"))
    else:
        path = F.concat(
            F.lit("tasks/"), task, F.when(kind == 1, "/tests/").otherwise("/src/"), letter,
            F.when(kind == 2, ".h").otherwise(".cpp"),
        )
    if hidden:
        path = F.regexp_replace(path, r"([^/]+)\z", F.concat(F.when(kind == 5, "_").when(kind == 6, ".").otherwise(""), F.lit("$1")))
    return table(spark, folder, "documents").select(path.alias("path"), F.coalesce("text", F.lit("")).alias("content"))


def metadata_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(path, content)`` of task metadata files."""
    meta = F.struct(
        F.lit("").alias("time_to_develop_prompt"),
        F.col("lang").alias("programming_language"),
        F.col("source").alias("task_type"),
        F.lit("hard").alias("difficulty"),
        F.col("n_chars").cast("string").alias("estimated_skill_requirements"),
        F.col("text").alias("user_prompt"),
    )
    return table(spark, folder, "documents").select(
        F.concat(F.lit("task"), "doc_id", F.lit("/metadata.json")).alias("path"), F.to_json(meta).alias("content")
    )


def logs(spark: SparkSession, folder: str) -> DataFrame:
    """Logs with terminal colours and a line to drop."""
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("run_id"),
        F.concat(
            F.lit("\x1b[1;32m"), "source", F.lit("\x1b[0m\n/Users/me/"), "lang", F.lit("\n"), "text"
        ).alias("log"),
    )

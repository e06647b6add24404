"""Source-text normalisation, so that many implementations fit one test suite.

A file is one row, so everything that works on file content is row-local and shuffle-free.  ``exported_function_lines``
is the same export rule for code kept as a table of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import JS_SPACE_CLASS, PY_SPACE_CLASS, PY_WORD_CLASS, js_trim, let
from codetrials.operators.ordered import SLIM_BITS, sum_before

_JS = f"[{JS_SPACE_CLASS}]"
_PY = f"[{PY_SPACE_CLASS}]"

# The patterns that define the rewrites.
JS_FUNCTION = rf"\A(?:async{_JS}+)?function{_JS}+([a-zA-Z$][a-zA-Z0-9_$]*){_JS}*\("  # names with "_" first are private
JS_EXPORTS = rf"module\.exports{_JS}*={_JS}*\{{[^}}]*\}};?{_JS}*\z"
JS_REQUIRE = rf"{_JS}*={_JS}*require\(['\"]\./[^'\"]+['\"]\)"
JS_IMPORT_NAMES = rf"const{_JS}*\{{([^}}]+)\}}{JS_REQUIRE}"
JS_IMPORT_ONE = rf"const{_JS}+([^={JS_SPACE_CLASS}]+){JS_REQUIRE}"
JS_IMPORT_ANY = rf"const{_JS}*(?:\{{[^}}]+\}}|[^={JS_SPACE_CLASS}]+){JS_REQUIRE}"
CPP_MAIN = r"[ \t]*int[ \t]+main[ \t]*\([^\n]*\)"
# The look-behind for a word start stands after the first letter, so it is tried at a "p" only.
JAVA_NARROW = rf"p(?<!{PY_WORD_CLASS}p)(?:rivate|rotected)"
JAVA_STATIC = rf"{JAVA_NARROW}{_PY}+static"
JAVA_FINAL_STATIC = rf"{JAVA_NARROW}{_PY}+final{_PY}+static"
JAVA_ANY_CLASS = rf"p(?:ublic |(?<!{PY_WORD_CLASS}p)(?:rivate|rotected){_PY}+)class {PY_WORD_CLASS}"
JAVA_CLASS = rf"public class ({PY_WORD_CLASS}+)"


# --- exported functions of JavaScript files ---------------------------------------------------------------------


def _count(line: Column, mark: str) -> Column:
    return F.octet_length(line) - F.octet_length(F.replace(line, F.lit(mark), F.lit("")))


def brace_balance(line: Column) -> Column:
    return _count(line, "{") - _count(line, "}")


def public_function(line: Column) -> Column:
    """Name of the public function a line declares, empty for other lines."""
    return F.regexp_extract(line, JS_FUNCTION, 1)


PIECE = 512


def _matters(line: Column) -> Column:
    """Cheap test that keeps every line with a brace or a function declaration."""
    marks = [F.contains(line, F.lit(m)) for m in "{}"] + [F.startswith(line, F.lit(w)) for w in ("function", "async")]
    return marks[0] | marks[1] | marks[2] | marks[3]


def exported_names(content: Column) -> Column:
    """Names of the functions declared at brace depth 0, in order of appearance, as an array.

    A fold that adds to an array copies it at every step, so the lines are cut into pieces of ``PIECE``: one fold over
    the pieces' balances gives the depth at which each begins, and the names are collected piece by piece.
    """

    def step(acc: Column, line: Column) -> Column:
        exported = (acc["depth"] == 0) & (line["name"] != "")
        return F.struct(
            (acc["depth"] + line["balance"]).alias("depth"),
            F.when(exported, F.concat(acc["names"], F.array(line["name"]))).otherwise(acc["names"]).alias("names"),
        )

    def names_of(pieces: Column) -> Column:
        zero = F.struct(F.lit(0).alias("depth"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(
            F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda acc, line: acc + line["balance"])),
            zero,
            lambda acc, n: F.struct(
                (acc["depth"] + n).alias("depth"), F.concat(acc["starts"], F.array(acc["depth"])).alias("starts")
            ),
            lambda acc: acc["starts"],
        )
        return F.flatten(
            F.transform(
                F.arrays_zip(pieces.alias("lines"), starts.alias("depth")),
                lambda z: F.aggregate(
                    z["lines"],
                    F.struct(z["depth"].alias("depth"), F.array().cast("array<string>").alias("names")),
                    step,
                    lambda acc: acc["names"],
                ),
            )
        )

    lines = F.filter(F.split(content, "\n", -1), _matters)
    parsed = F.transform(
        lines, lambda s: F.struct(brace_balance(s).alias("balance"), public_function(s).alias("name"))
    )
    cut = lambda rows: F.transform(
        F.sequence(F.lit(0), F.floor(F.size(rows) / PIECE).cast("int")),
        lambda k: F.slice(rows, k * PIECE + 1, F.lit(PIECE)),
    )
    return let(let(parsed, cut), names_of)


def exported_functions(impl_files: DataFrame) -> DataFrame:
    """``impl_files`` plus ``exports ARRAY<STRING>``."""
    return impl_files.withColumn("exports", exported_names(F.col("content")))


def exported_function_lines(
    lines: DataFrame, keys: list[str], seq: str = "pos", line: str = "line", bits: int | None = SLIM_BITS
) -> DataFrame:
    """Export rule over a table of lines -> ``(*keys, seq, name)``.

    Lines that neither declare a function nor change the depth are dropped before the shuffle, and the line text
    itself is not shuffled at all.
    """
    parsed = lines.where(_matters(F.col(line))).select(
        *keys,
        seq,
        brace_balance(F.col(line)).cast("bigint").alias("_balance"),
        public_function(F.col(line)).alias("name"),
    )
    depth = sum_before(parsed, keys, seq, "_balance", "_depth", bits)
    return depth.where((F.col("_depth") == 0) & (F.col("name") != "")).select(*keys, seq, "name")


def with_exports(content: Column, exports: Column) -> Column:
    bare = F.regexp_replace(content, JS_EXPORTS, "")
    statement = F.concat(F.lit("\nmodule.exports = { "), F.array_join(exports, ", "), F.lit(" };\n"))
    return F.when(F.size(exports) > 0, F.concat(js_trim(bare), statement)).otherwise(bare)


def add_exports(impl_files: DataFrame) -> DataFrame:
    """Replace a closing ``module.exports`` by one that names every exported function."""
    content = let(exported_names(F.col("content")), lambda names: with_exports(F.col("content"), names))
    return impl_files.withColumn("content", content)


# --- import statement of a JavaScript test suite -----------------------------------------------------------------


def import_head(content: Column) -> Column:
    """``const { f } = require`` or ``const C = require`` as the suite uses it, NULL if it requires no local file."""
    names = js_trim(F.regexp_extract(content, JS_IMPORT_NAMES, 1))
    one = js_trim(F.regexp_extract(content, JS_IMPORT_ONE, 1))
    return F.when(
        content.rlike(JS_IMPORT_NAMES), F.concat(F.lit("const { "), names, F.lit(" } = require"))
    ).when(content.rlike(JS_IMPORT_ONE), F.concat(F.lit("const "), one, F.lit(" = require")))


NO_SUITE = "no test file"


def last_suites(test_files: DataFrame, keys: tuple[str, ...] = ("task_id",)) -> DataFrame:
    """One suite for each key: of several, which are copied onto one target in the order of their paths, the last."""
    keys = tuple(k for k in keys if k in test_files.columns)
    if "path" not in test_files.columns:
        return test_files
    last = test_files.groupBy(*keys).agg(F.max(F.struct("path", "content")).alias("_last"))
    return last.select(*keys, "_last.path", "_last.content")


def rewrite_import(test_files: DataFrame, impl_files: DataFrame) -> DataFrame:
    """Point each suite's first local import at every implementation of its task.

    -> ``(task_id, impl, content, reject_reason)``; ``content`` is NULL for a suite without such an import.  The
    suite is analysed once, before the join; the join only splices the path in.
    """
    text = F.col("content")
    found = F.regexp_extract(text, JS_IMPORT_ANY, 0)
    suites = last_suites(test_files).select(
        "task_id",
        text.alias("_suite"),
        # "$$" is how a JavaScript replacement spells one "$".
        F.replace(import_head(text), F.lit("$$"), F.lit("$")).alias("_head"),
        F.position(found, text).alias("_at"),
        F.length(found).alias("_length"),
    )
    statement = F.concat(F.col("_head"), F.lit("('"), F.col("path"), F.lit("')"))
    spliced = F.overlay(F.col("_suite"), statement, F.col("_at"), F.col("_length"))
    return (
        impl_files.select("task_id", "impl", "path")
        .join(suites, "task_id", "left")
        .select(
            "task_id",
            "impl",
            F.when(F.col("_head").isNotNull(), spliced).alias("content"),
            F.when(F.col("_suite").isNull(), NO_SUITE)
            .when(F.col("_head").isNull(), F.lit("no require statement"))
            .alias("reject_reason"),
        )
    )


# --- Java classes ----------------------------------------------------------------------------------------------


def java_target(test_files: DataFrame) -> DataFrame:
    """``(task_id, target)``: the class name the first suite (by path) of each task expects.

    The text is reduced to a flag before the shuffle.
    """
    flags = test_files.where(F.col("language") == "Java").select(
        "task_id", "path", F.contains(F.col("content"), F.lit("Solution")).alias("_solution")
    )
    return flags.groupBy("task_id").agg(
        F.when(F.min_by("_solution", "path"), "Solution").otherwise("Main").alias("target")
    )


def open_access(content: Column) -> Column:
    """Make private and protected members public."""
    out = F.regexp_replace(content, JAVA_STATIC, "public static")
    out = F.regexp_replace(out, JAVA_FINAL_STATIC, "public static final")
    return F.regexp_replace(out, rf"{JAVA_NARROW}{_PY}+", "public ")


def has_public_class(content: Column) -> Column:
    """Whether :func:`open_access` leaves a public class, told from the text as it stands."""
    return content.rlike(JAVA_ANY_CLASS)


def main_class(opened: Column) -> Column:
    """The first public class of a text that :func:`open_access` has been through; empty if there is none."""
    return F.regexp_extract(opened, JAVA_CLASS, 1)


# A character that is in no word, and what stands for it and for a name while names are replaced.
_MARK = "\uffff"
_MARK_ITSELF, _MARK_NAME = _MARK + ".", _MARK + ";"


def rename_class(content: Column, name: Column, target: Column) -> Column:
    """Rename a class, except after ``new `` unless a parenthesis follows.

    The text is cut at the name by a constant pattern, so no row brings a regex of its own.  A mention stands between two
    pieces that do not touch it with a word character; an empty piece between two mentions does.
    """

    def named(pieces: Column) -> Column:
        last = F.size(pieces) - 1

        def between(piece: Column, i: Column) -> Column:
            after = F.get(pieces, i + 1)
            free = F.when(piece == "", i == 0).otherwise(~F.substring(piece, -1, 1).rlike(PY_WORD_CLASS))
            free = free & F.when(after == "", i + 1 == last).otherwise(~F.substring(after, 1, 1).rlike(PY_WORD_CLASS))
            made = F.endswith(piece, F.lit("new ")) & ~F.startswith(after, F.lit("("))
            mention = F.when(free & ~made, target).otherwise(name)
            return F.when(i == last, piece).otherwise(F.concat(piece, mention))

        return F.array_join(F.transform(pieces, between), "")

    marked = F.replace(F.replace(content, F.lit(_MARK), F.lit(_MARK_ITSELF)), name, F.lit(_MARK_NAME))
    out = let(F.split(marked, _MARK_NAME, -1), named)
    return F.replace(out, F.lit(_MARK_ITSELF), F.lit(_MARK))


def normalize_java(impl_files: DataFrame, test_files: DataFrame) -> DataFrame:
    """Java files with open access and the class name their task's suite expects.

    -> ``(task_id, impl, target, content, reject_reason)``; a file without a public class, or whose task
    has no suite, has NULL content.  Files are opened after they have met their task's class name, and only then.
    """
    targets = java_target(test_files)
    files = impl_files.where(F.col("language") == "Java").select("task_id", "impl", F.col("content").alias("_content"))
    met = files.join(targets, "task_id", "left")
    opened = F.when(F.col("target").isNotNull(), open_access(F.col("_content")))
    # bound once: the class is searched in, and the name replaced in, the same text
    both = let(opened, lambda text: F.struct(text.alias("text"), main_class(text).alias("name")))
    named = met.select("task_id", "impl", "target", F.explode(F.array(both)).alias("_java"))
    text, name = F.col("_java.text"), F.col("_java.name")
    has_class = F.col("target").isNotNull() & (name != "")
    return named.select(
        "task_id",
        "impl",
        "target",
        F.when(has_class, rename_class(text, name, F.col("target"))).alias("content"),
        F.when(F.col("target").isNull(), NO_SUITE)
        .when(~has_class, F.lit("no public class"))
        .alias("reject_reason"),
    )


# --- main functions of C++ files -------------------------------------------------------------------------------


def _exit_line(lines: Column, balanced: bool) -> Column:
    """Index of the line that closes the main function which line 0 opens, NULL if nothing does."""

    def step(acc: Column, line: Column) -> Column:
        if balanced:
            opened, closed = _count(line, "{"), _count(line, "}")
            seen = acc["seen"] | (opened > 0)
            braces = acc["braces"] + opened - closed
            leaves = seen & (braces <= 0)
        else:
            start = F.ltrim(line, F.lit(" \t"))
            closing = F.startswith(start, F.lit("}"))
            seen = acc["seen"]
            braces = acc["braces"] + F.when(F.startswith(start, F.lit("{")), 1).when(closing, -1).otherwise(0)
            leaves = closing & (braces == 0)
        return F.struct(
            (acc["at"] + 1).alias("at"),
            braces.cast("int").alias("braces"),
            seen.alias("seen"),
            F.coalesce(acc["left"], F.when(leaves, acc["at"])).alias("left"),
        )

    start = F.struct(
        F.lit(0).alias("at"),
        F.lit(0).alias("braces"),
        F.lit(False).alias("seen"),
        F.lit(None).cast("int").alias("left"),
    )
    return F.aggregate(lines, start, step, lambda acc: acc["left"])


def without_main(content: Column, mode: str = "faithful") -> Column:
    """Source text without its main functions; every kept line ends with ``\\n``.

    ``faithful`` counts a brace only where it starts a line, so a main whose brace is on its own header line takes
    the rest of the file with it (up to the next main); ``balanced`` counts every brace.

    The text is cut at the main headers, so each piece after the first is one main function and what follows it:
    one counting fold per piece finds where the function ends, and no fold builds up text.
    """
    if mode not in ("faithful", "balanced"):
        raise ValueError(f"unknown mode {mode!r}")

    def rest(lines: Column) -> Column:
        after = let(
            _exit_line(lines, mode == "balanced"),
            lambda left: F.when(left.isNotNull(), F.slice(lines, left + 2, F.size(lines))),
        )
        return F.array_join(F.coalesce(after, F.array().cast("array<string>")), "\n")

    ended = F.when((content == "") | F.endswith(content, F.lit("\n")), content).otherwise(
        F.concat(content, F.lit("\n"))
    )
    # Cutting before a header leaves "<text before>" and then one piece per header.
    pieces = F.split(ended, rf"(?md)^(?={CPP_MAIN})", -1)
    return F.array_join(
        F.transform(
            pieces,
            lambda piece: F.when(
                piece.rlike(rf"\A{CPP_MAIN}"), let(F.split(piece, "\n", -1), rest)
            ).otherwise(piece),
        ),
        "",
    )


def remove_main(impl_files: DataFrame, mode: str = "faithful") -> DataFrame:
    return impl_files.withColumn("content", without_main(F.col("content"), mode))

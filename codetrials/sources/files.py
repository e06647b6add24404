"""Source files as rows: implementations, test suites, task metadata.

``read_files`` turns a folder tree into ``(path, content)`` with paths relative to the root; everything after that is
a projection, so a corpus that is kept as a table of files needs no folder at all.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrials.functions.text import base_name, file_stem
from codetrials.schemas import CPP_TARGETS, TASK_METADATA, TASK_METADATA_FIELDS

@dataclass(frozen=True)
class Layout:
    """Where a runner keeps its files: globs for the scan, a pattern with the task id as its first group."""

    language: str
    globs: tuple[str, ...]
    code: str
    test_globs: tuple[str, ...]
    test: str
    stem: str | None = None
    reserved: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    recursive: bool = False


# Folder conventions of the runners, one folder per task.
LAYOUTS = {
    "java": Layout(
        "Java", ("*/code",), r"\A([^/]+)/code/.*\.java\z", ("*/test",), r"\A([^/]+)/test/.*\.java\z",
        stem="java", forbidden=("build", ".gradle"), recursive=True,
    ),
    "python": Layout(
        "Python", ("*/*.py",), r"\A([^/]+)/[^/]+\.py\z", ("*/test.py",), r"\A([^/]+)/test\.py\z",
        stem="python", reserved=("test.py", "solution.py"),
    ),
    "js": Layout(
        "JavaScript", ("*/*.js",), r"\A([^/]+)/[^/]+\.js\z", ("*/index.test.js",), r"\A([^/]+)/index\.test\.js\z",
        reserved=("solution.js", "index.test.js"),
    ),
    "js_v1": Layout(
        "JavaScript", ("*/base_code.js", "*/solution.js", "*/alternate_responses/*.js"),
        r"\A([^/]+)/(?:base_code\.js|solution\.js|alternate_responses/[^/]*\.js)\z",
        ("*/index.test.js",), r"\A([^/]+)/index\.test\.js\z", stem="js",
    ),
    "cpp": Layout(
        "C++", ("tasks/*/src/*.cpp",), r"\Atasks/([^/]+)/src/[^/]+\.cpp\z",
        ("tasks/*/tests/test_model.cpp",), r"\Atasks/([^/]+)/tests/test_model\.cpp\z", stem="cpp",
    ),
}


HIDDEN = "the reader hides names that begin with _ or ."
BROKEN = "not a JSON object"


def _qualified(spark: SparkSession, root: str) -> str:
    """The root as the file system spells it, with scheme and without a relative part or a closing slash."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return path.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toString().rstrip("/")


def _relative(root: str) -> Column:
    """Path of the scanned file below the qualified ``root``; ``_metadata.file_path`` is percent-encoded.

    The root is a prefix of the path, at one place only.  A file that is not below it would be a mistake of the scan.
    """
    bare = lambda c: F.regexp_replace(c, r"\A([a-z0-9+.-]+:)/+", r"$1/")  # noqa: E731  file:/x and file:///x are one
    full = bare(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))))
    base = bare(F.lit(root + "/"))
    below = F.substr(full, F.length(base) + F.lit(1))
    outside = F.raise_error(F.concat(full, F.lit(f" is not below {root}"))).cast("string")
    return F.when(F.startswith(full, base), below).otherwise(outside)


def _hidden(spark: SparkSession, root: str, glob: str, suffix: str | None, recursive: bool) -> list[str]:
    """Paths below ``root`` that match ``glob`` but that Spark's listing leaves out.  Names only, no content; of a
    recursive listing only the hidden names are held."""
    jvm = spark._jvm
    folder, _, last = glob.rpartition("/")
    wanted = f"{root}/{glob}" if recursive or not last.startswith("*") else f"{root}/{folder}/[_.]{last}"
    path = jvm.org.apache.hadoop.fs.Path(wanted)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    depth = glob.count("/") + (1 if recursive else 0)
    found = []

    def keep(full: str) -> None:
        if full.startswith(root + "/") and (not suffix or full.endswith(suffix.lstrip("*"))):
            below = full[len(root) + 1 :]
            if any(n[0] in "_." for n in below.split("/")[depth if recursive else -1 :]):
                found.append(below)

    for status in fs.globStatus(path) or []:
        if not status.isDirectory():
            keep(status.getPath().toString())
        elif recursive:
            listing = fs.listFiles(status.getPath(), True)
            while listing.hasNext():
                keep(listing.next().getPath().toString())
    return found


def read_files(
    spark: SparkSession, root: str, globs: Sequence[str], name_glob: str | None = None, recursive: bool = False
) -> DataFrame:
    """``(path, content, reject_reason)``; globs that match nothing add nothing.

    Spark's readers leave out names that begin with ``_`` or ``.``; such files are rows without content and with a
    reason, so that nothing is absent without a trace.
    """
    root = _qualified(spark, root)
    reader = spark.read.format("text").option("wholetext", True)
    if name_glob:
        reader = reader.option("pathGlobFilter", name_glob)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    nothing = F.lit(None).cast("string")
    out = spark.range(0).select(nothing.alias("path"), nothing.alias("content"), nothing.alias("reject_reason"))
    hidden: list[str] = []
    for glob in globs:
        hidden += _hidden(spark, root, glob, name_glob, recursive)
        try:
            found = reader.load(f"{root}/{glob}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = out.unionByName(
            found.select(_relative(root).alias("path"), F.col("value").alias("content"), nothing.alias("reject_reason"))
        )
    if hidden:
        names = spark.createDataFrame([(h,) for h in sorted(set(hidden))], "path string")
        out = out.unionByName(names.select("path", nothing.alias("content"), F.lit(HIDDEN).alias("reject_reason")))
    return out


def _allowed(found: DataFrame, rule: Layout) -> DataFrame:
    """Drop the paths that contain a forbidden part below the task's own folder."""
    inner = F.regexp_replace("path", r"\A[^/]+/", "")
    for part in rule.forbidden:
        found = found.where(~F.contains(inner, F.lit(part)))
    return found


def _reason(files: DataFrame) -> list[str]:
    return [c for c in files.columns if c == "reject_reason"]


def select_impls(files: DataFrame, layout: str) -> DataFrame:
    """``(path, content)`` -> ``(task_id, impl, language, path, content)`` of the implementation files;
    a ``reject_reason`` is kept."""
    rule = LAYOUTS[layout]
    path = F.col("path")
    kept = _allowed(files.where(path.rlike(rule.code)), rule)
    if rule.reserved:
        kept = kept.where(~base_name(path).isin(*rule.reserved))
    impl = file_stem(path, rule.stem) if rule.stem else base_name(path)
    return kept.select(
        F.regexp_extract(path, rule.code, 1).alias("task_id"),
        impl.alias("impl"),
        F.lit(rule.language).alias("language"),
        "path",
        "content",
        *_reason(kept),
    )


def select_tests(files: DataFrame, layout: str) -> DataFrame:
    """``(path, content)`` -> ``(task_id, language, path, content)`` of the test suites."""
    rule = LAYOUTS[layout]
    path = F.col("path")
    kept = _allowed(files.where(path.rlike(rule.test)), rule)
    return kept.select(
        F.regexp_extract(path, rule.test, 1).alias("task_id"),
        F.lit(rule.language).alias("language"),
        "path",
        "content",
        *_reason(kept),
    )


def scan_impl_files(spark: SparkSession, root: str, layout: str, task_id: str | None = None) -> DataFrame:
    """Implementations below ``root``.  ``task_id`` narrows the listing itself to one task."""
    rule = LAYOUTS[layout]
    return select_impls(read_files(spark, root, _narrow(rule.globs, task_id), _suffix(rule), rule.recursive), layout)


def scan_test_files(spark: SparkSession, root: str, layout: str, task_id: str | None = None) -> DataFrame:
    """Test suites below ``root``."""
    rule = LAYOUTS[layout]
    return select_tests(
        read_files(spark, root, _narrow(rule.test_globs, task_id), _suffix(rule), rule.recursive), layout
    )


def _narrow(globs: Sequence[str], task_id: str | None) -> list[str]:
    """Put the task id in the place of the first folder wildcard."""
    return [g if task_id is None else g.replace("*", task_id, 1) for g in globs]


def _suffix(rule: Layout) -> str | None:
    return "*.java" if rule.recursive else None


def cpp_target(impl: Column) -> Column:
    """Build target of a C++ implementation."""
    return F.concat(impl, F.lit("_tests"))


def fixed_targets(impls: DataFrame) -> DataFrame:
    """C++ implementations with one of the six agreed names, the only ones that some runners test."""
    return impls.where(F.col("impl").isin(CPP_TARGETS))


def parse_task_metadata(files: DataFrame) -> DataFrame:
    """``(path, content)`` of ``<task>/metadata.json`` files -> ``task_id``, the six metadata fields and
    ``reject_reason``: the one the file came with, or that its text is no JSON object."""
    rule = r"\A(?:.*/)?([^/]+)/metadata\.json\z"
    given = F.col("reject_reason") if "reject_reason" in files.columns else F.lit(None).cast("string")
    meta = F.from_json("content", TASK_METADATA)
    unreadable = F.json_object_keys("content").isNull()
    return (
        files.where(F.col("path").rlike(rule))
        .select(
            F.regexp_extract("path", rule, 1).alias("task_id"), meta.alias("_meta"),
            F.coalesce(given, F.when(unreadable, BROKEN)).alias("reject_reason"),
        )
        .select("task_id", *[F.col(f"_meta.{f}").alias(f) for f in TASK_METADATA_FIELDS], "reject_reason")
    )


def read_task_metadata(spark: SparkSession, root: str) -> DataFrame:
    return parse_task_metadata(read_files(spark, root, ["*/metadata.json"]))

"""Named queries: every operator on tables derived from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrials.functions import text
from codetrials.operators import code, coverage, jest, layout, main_lines, notebooks, ranges, render, reports, summary, tasks, verdicts
from codetrials.plans import derived, flows
from codetrials.plans.scratch import scratch_path
from codetrials.sources import files, folders, readers, store, writers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return register


# --- notebooks ---------------------------------------------------------------------------------------------------


@query("notebook_fields")
def notebook_fields(spark: SparkSession, d: str) -> DataFrame:
    return notebooks.extract_fields(derived.notebook_cells(spark, d))


@query("notebook_records")
def notebook_records(spark: SparkSession, d: str) -> DataFrame:
    return notebooks.pivot_fields(notebook_fields(spark, d))


def _packed(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "notebooks")
    derived.packed_notebooks(spark, d).write.text(path)
    return readers.read_notebooks(spark, path, packed=True)


@query("notebook_scan")
def notebook_scan(spark: SparkSession, d: str) -> DataFrame:
    return readers.notebook_cells(_packed(spark, d))


def _parsed(spark: SparkSession, d: str) -> DataFrame:
    return readers.parse_notebooks(derived.packed_notebooks(spark, d))


@query("notebook_fields_nested")
def notebook_fields_nested(spark: SparkSession, d: str) -> DataFrame:
    return notebooks.extract_fields_nested(_parsed(spark, d))


@query("notebook_records_nested")
def notebook_records_nested(spark: SparkSession, d: str) -> DataFrame:
    return flows.records_of_notebooks(_parsed(spark, d))


@query("notebook_quarantine")
def notebook_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return _parsed(spark, d).where(F.col("reject_reason").isNotNull()).select("notebook", "reject_reason")


# --- tasks ---------------------------------------------------------------------------------------------------------


def _decoded(spark: SparkSession, d: str) -> DataFrame:
    return tasks.decode_tests(derived.tasks(spark, d))


@query("task_scan")
def task_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "tasks")
    writers.write_tasks(derived.tasks(spark, d), path)
    return readers.read_tasks(spark, path, multi_line=False).drop("test_list")


@query("task_json")
def task_json(spark: SparkSession, d: str) -> DataFrame:
    return writers.task_json(
        derived.tasks(spark, d).withColumn(
            "entry_point", F.when(F.col("task_id") % 3 != 0, F.col("entry_point"))
        )
    )


@query("decode_tests")
def decode_tests(spark: SparkSession, d: str) -> DataFrame:
    return _decoded(spark, d).select(
        "task_id", F.size("tests").alias("n_tests"), F.array_join("tests", "|").alias("tests")
    )


@query("decode_tests_literal")
def decode_tests_literal(spark: SparkSession, d: str) -> DataFrame:
    """Test lists of the five shapes that need the Python-literal reading."""
    shape = F.col("task_id") % 5
    body = F.expr("substring(test, 2, length(test) - 2)")
    shaped = derived.tasks(spark, d).withColumn(
        "test",
        F.when(shape == 0, F.concat(F.lit("("), body, F.lit(",)")))
        .when(shape == 1, F.concat(F.lit("["), body, F.lit(",]")))
        .when(shape == 2, F.concat(F.lit("['\\x41' 'b', "), body, F.lit("]")))
        .when(shape == 3, F.concat(F.lit("[1, "), body, F.lit("]")))
        .otherwise(F.concat(F.lit("['it\\'s', "), body, F.lit("]"))),
    )
    return tasks.decode_tests(shaped).select("task_id", F.array_join("tests", "|").alias("tests"))


def _with_holes(spark: SparkSession, d: str) -> DataFrame:
    number = F.col("task_id")
    return derived.tasks(spark, d).withColumns(
        {
            "prompt": F.when(number % 7 != 0, F.col("prompt")),
            "entry_point": F.when(number % 11 != 0, F.col("entry_point")),
            "test": F.when(number % 13 == 0, "[oops").otherwise(F.col("test")),
        }
    )


@query("task_quarantine")
def task_quarantine(spark: SparkSession, d: str) -> DataFrame:
    return tasks.quarantined(flows.checked_tasks(_with_holes(spark, d))).select("task_id", "language", "reject_reason")


@query("task_routing")
def task_routing(spark: SparkSession, d: str) -> DataFrame:
    """Good and rejected records in one write, with the counts observed on the way."""
    path = scratch_path(spark, "routed")
    counts = writers.write_routed(flows.checked_tasks(_with_holes(spark, d)), path)
    seen = [F.lit(counts[c]).cast("bigint").alias(f"n_{c}") for c in ("usable", "rejected")]
    return spark.read.parquet(path).select("task_id", "language", "outcome", "reject_reason", F.size("tests").alias("n_tests"), *seen)


@query("language_routing")
def language_routing(spark: SparkSession, d: str) -> DataFrame:
    return derived.tasks(spark, d).select("task_id", "language", tasks.is_handled().alias("handled"))


@query("entry_class")
def entry_class(spark: SparkSession, d: str) -> DataFrame:
    return derived.tasks(spark, d).select("task_id", text.entry_class("entry_point").alias("entry_class"))


@query("solution_variants")
def solution_variants(spark: SparkSession, d: str) -> DataFrame:
    return tasks.explode_variants(derived.tasks(spark, d)).select("task_id", "variant", "solution")


@query("text_dedent")
def text_dedent(spark: SparkSession, d: str) -> DataFrame:
    """Dedent and indent over document lines with a mixed margin, blank lines included."""
    lines = F.regexp_replace("text", r"\. ", ".\n \t\n \t  ")
    margined = F.concat(F.lit(" \t "), F.replace(lines, F.lit("\n"), F.lit("\n \t")))
    # as the output of a generator the dedented text is made once for both of its uses
    once = F.explode(F.array(text.py_dedent("t"))).alias("dedented")
    return (
        derived.table(spark, d, "documents")
        .select("doc_id", margined.alias("t"))
        .select("doc_id", "t", once)
        .select("doc_id", "dedented", text.py_indent("dedented", 4).alias("indented"), text.py_dedent(text.py_strip("t")).alias("stripped_first"))
    )


def _render(language: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return render.render(_decoded(spark, d), language)

    return run


for _name, _language in (
    ("render_cpp", "C++"), ("render_python", "Python"), ("render_java", "Java"), ("render_js", "JavaScript"),
):
    query(_name)(_render(_language))


@query("render_all")
def render_all(spark: SparkSession, d: str) -> DataFrame:
    return render.render_all(_decoded(spark, d)).select("task_id", "variant", "language", "file_name", "source")


# --- source code -----------------------------------------------------------------------------------------------------


@query("exported_functions")
def exported_functions(spark: SparkSession, d: str) -> DataFrame:
    return code.exported_function_lines(derived.js_lines(spark, d), ["file_id"])


@query("exported_functions_text")
def exported_functions_text(spark: SparkSession, d: str) -> DataFrame:
    exported = code.exported_functions(derived.js_impls(spark, d))
    return exported.select("task_id", "impl", F.array_join("exports", ",").alias("exports"))


@query("add_exports")
def add_exports(spark: SparkSession, d: str) -> DataFrame:
    return code.add_exports(derived.js_impls(spark, d)).select("task_id", "impl", "content")


@query("remove_main")
def remove_main(spark: SparkSession, d: str) -> DataFrame:
    return code.remove_main(derived.cpp_impls(spark, d)).select("task_id", "impl", "content")


@query("remove_main_balanced")
def remove_main_balanced(spark: SparkSession, d: str) -> DataFrame:
    return code.remove_main(derived.cpp_impls(spark, d), "balanced").select("task_id", "impl", "content")


@query("remove_main_lines")
def remove_main_lines(spark: SparkSession, d: str) -> DataFrame:
    return main_lines.remove_main_lines(derived.cpp_lines(spark, d), ["task_id", "impl"])


def _one_file(mode: str) -> Query:
    """A file of all lines, cut into runs of 16 documents."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return main_lines.remove_main_lines(derived.cpp_amalgam(spark, d), ["lang"], mode=mode, bits=24)

    return run


query("remove_main_one_file")(_one_file("faithful"))
query("remove_main_one_file_balanced")(_one_file("balanced"))


@query("normalize_java")
def normalize_java(spark: SparkSession, d: str) -> DataFrame:
    return code.normalize_java(derived.java_impls(spark, d), derived.tests(spark, d))


@query("java_target")
def java_target(spark: SparkSession, d: str) -> DataFrame:
    return code.java_target(derived.tests(spark, d))


@query("java_target_of_suites")
def java_target_of_suites(spark: SparkSession, d: str) -> DataFrame:
    """Several suites a task: the first by path tells the class."""
    return code.java_target(derived.more_tests(spark, d))


@query("rewrite_import")
def rewrite_import(spark: SparkSession, d: str) -> DataFrame:
    return code.rewrite_import(derived.js_tests(spark, d), derived.js_impls(spark, d))


# --- layout ------------------------------------------------------------------------------------------------------------


def _impl_scan(kind: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = files.select_impls(derived.source_tree(spark, d, kind), kind)
        return found.select("task_id", "impl", "language", "path", "content")

    return run


def _folder_scan(kind: str) -> Query:
    """A written tree, hidden names included, read by tasks that list its folders."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        root = scratch_path(spark, "tree")
        folders.write_files(derived.source_tree(spark, d, kind, hidden=True), root)
        return folders.scan_impls(spark, root, kind).select("task_id", "impl", "language", "path", "content", "reject_reason")

    return run


for _name, _kind in (
    ("impl_scan_java", "java"), ("impl_scan_python", "python"), ("impl_scan_js", "js"),
    ("impl_scan_js_v1", "js_v1"), ("impl_scan_cpp", "cpp"),
):
    query(_name)(_impl_scan(_kind))
    query(_name.replace("impl", "folder"))(_folder_scan(_kind))


@query("folder_scan_of_tasks")
def folder_scan_of_tasks(spark: SparkSession, d: str) -> DataFrame:
    """A condition on the task reaches the listing: no other folder is opened."""
    root = scratch_path(spark, "tree")
    folders.write_files(derived.source_tree(spark, d, "python", hidden=True), root)
    wanted = [str(k) for k in range(0, 1000, 7)]
    return folders.scan_impls(spark, root, "python", wanted).select("task_id", "impl", "path", "content")


@query("metadata_scan")
def metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    return files.parse_task_metadata(derived.metadata_files(spark, d))


@query("impl_test_fanout")
def impl_test_fanout(spark: SparkSession, d: str) -> DataFrame:
    pairs = layout.fan_out(derived.impls(spark, d), derived.tests(spark, d))
    return pairs.select("task_id", "impl", "path", "test_path", "test_content", "content")


@query("impl_test_fanout_of_suites")
def impl_test_fanout_of_suites(spark: SparkSession, d: str) -> DataFrame:
    """Several suites a task: the last by path is the one that is there."""
    pairs = layout.fan_out(derived.impls(spark, d), derived.more_tests(spark, d))
    return pairs.select("task_id", "impl", "test_path", "test_content")


@query("layout_violations")
def layout_violations(spark: SparkSession, d: str) -> DataFrame:
    impls = derived.java_impls(spark, d).unionByName(derived.js_impls(spark, d))
    suites = derived.tests(spark, d).unionByName(derived.js_tests(spark, d))
    return layout.validate_layout(impls, suites)


# --- verdicts ------------------------------------------------------------------------------------------------------------

RUN_KEYS = ("run_id", "task_id", "impl")


@query("verdict_compiled")
def verdict_compiled(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.classify_compiled(derived.runs(spark, d), RUN_KEYS)


@query("verdict_interpreted")
def verdict_interpreted(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.classify_interpreted(derived.runs(spark, d), RUN_KEYS)


def _gradle(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.classify_gradle(derived.runs(spark, d), RUN_KEYS)


@query("verdict_gradle")
def verdict_gradle(spark: SparkSession, d: str) -> DataFrame:
    """Both arms of the wrapper failure and an exception, next to ordinary runs."""
    number = F.col("run_id")
    runs = derived.runs(spark, d).withColumns(
        {
            "exception": F.when(number % 31 == 0, F.concat(F.lit("boom "), number.cast("string"))),
            "wrapper_failed": number % 29 == 0,
        }
    )
    return tasks.union_languages(
        verdicts.classify_gradle(runs, RUN_KEYS, "mac").withColumn("platform", F.lit("mac")),
        verdicts.classify_gradle(runs, RUN_KEYS, "windows").withColumn("platform", F.lit("windows")),
    )


@query("build_gate")
def build_gate(spark: SparkSession, d: str) -> DataFrame:
    kept = verdicts.gate_on_build(derived.runs(spark, d), RUN_KEYS, "run_id")
    return kept.select(*RUN_KEYS, "returncode", "timed_out", "stdout", "stderr")


@query("build_skipped")
def build_skipped(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.skipped_by_build(derived.runs(spark, d), RUN_KEYS, "run_id").select(*RUN_KEYS)


def _attached(spark: SparkSession, d: str) -> DataFrame:
    judged = verdicts.classify_compiled(derived.runs(spark, d), ("run_id", "task_id")).select(
        F.col("task_id").alias("task_key"), derived.variant_of_run().alias("variant"), "run_id", "status", "output"
    )
    keyed = tasks.route_language(derived.tasks(spark, d)).withColumn(
        "task_key", F.floor(F.col("task_id") / 100).cast("bigint")
    )
    return verdicts.attach_verdicts(keyed, judged, "task_key", order="run_id")


@query("attach_verdicts")
def attach_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return _attached(spark, d).select(
        "task_id", "language", "prompt", "ir_test_status", "ir_test_output", "incs_test_status", "incs_test_output"
    )


@query("discriminating_tasks")
def discriminating_tasks(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.discriminating_tasks(_attached(spark, d)).select("task_id", "language")


@query("attach_verdicts_bucketed")
def attach_verdicts_bucketed(spark: SparkSession, d: str) -> DataFrame:
    """Tasks and verdicts kept in buckets of the task: they meet without an exchange."""
    judged = verdicts.classify_compiled(derived.runs(spark, d), ("run_id", "task_id")).select(
        F.col("task_id").alias("task_key"), derived.variant_of_run().alias("variant"), "run_id", "status", "output"
    )
    keyed = tasks.route_language(derived.tasks(spark, d)).withColumn("task_key", F.floor(F.col("task_id") / 100).cast("bigint"))
    keyed, judged = (store.bucketed(t, scratch_path(spark, "bucketed"), ["task_key"], 16) for t in (keyed, judged))
    return verdicts.attach_verdicts(keyed, judged, "task_key", order="run_id").select(
        "task_id", "language", "prompt", "ir_test_status", "ir_test_output", "incs_test_status", "incs_test_output"
    )


def _run_languages(spark: SparkSession, d: str) -> DataFrame:
    return (
        derived.tasks(spark, d)
        .select(F.floor(F.col("task_id") / 100).cast("bigint").alias("task_id"), "language")
        .distinct()
    )


@query("judged_runs")
def judged_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs of five languages, one of them unsupported, judged together."""
    return flows.judged_runs(derived.runs(spark, d), _run_languages(spark, d), RUN_KEYS)


@query("unjudged_runs")
def unjudged_runs(spark: SparkSession, d: str) -> DataFrame:
    """The runs that ``judged_runs`` leaves out, of odd tasks as if those were unknown."""
    known = _run_languages(spark, d).where(F.col("task_id") % 2 == 0)
    return flows.unjudged_runs(derived.runs(spark, d), known, RUN_KEYS)


# --- Jest ------------------------------------------------------------------------------------------------------------------


@query("jest_parse")
def jest_parse(spark: SparkSession, d: str) -> DataFrame:
    return jest.parse_jest(derived.jest(spark, d)).select(
        "run_id", "parsed", "passed", "total", F.col("suite.status").alias("suite_status"),
        F.size("suite.assertionResults").alias("n_cases"),
    )


def _classified(spark: SparkSession, d: str, version: str) -> DataFrame:
    return jest.classify_jest(jest.parse_jest(derived.jest(spark, d)), version)


@query("verdict_jest")
def verdict_jest(spark: SparkSession, d: str) -> DataFrame:
    """Both versions' verdicts out of one parse."""
    verdict_of = [F.struct(jest.jest_verdict(v).alias("verdict"), F.lit(v).alias("version")) for v in jest.VERSIONS]
    both = jest.parse_jest(derived.jest(spark, d)).select("run_id", F.inline(F.array(*verdict_of)))
    return both.select("run_id", "verdict.*", "version")


@query("test_summary")
def test_summary(spark: SparkSession, d: str) -> DataFrame:
    return flows.jest_results(derived.jest(spark, d))


@query("case_results")
def case_results(spark: SparkSession, d: str) -> DataFrame:
    return jest.case_results(jest.parse_jest(derived.jest(spark, d)), ("run_id", "task_id", "impl"))


@query("report_text")
def report_text(spark: SparkSession, d: str) -> DataFrame:
    reported = reports.jest_report(_classified(spark, d, "v2"), F.lit("1970-01-01T00:00:00.000Z"))
    return reported.select("run_id", "report")


@query("jest_console")
def jest_console(spark: SparkSession, d: str) -> DataFrame:
    return reports.jest_console(_classified(spark, d, "v1")).select("run_id", "console")


@query("jest_summary_lines")
def jest_summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.jest_summary_lines(test_summary(spark, d))


# --- coverage ------------------------------------------------------------------------------------------------------------------


@query("jacoco_scan")
def jacoco_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "jacoco")
    derived.jacoco_csv(spark, d).write.partitionBy("run").option("header", True).csv(path)
    return readers.read_jacoco(spark, path, "run")


def _reports(spark: SparkSession, d: str) -> DataFrame:
    """Written reports of two column orders in one folder, some of them with rows that are rejected."""
    path = scratch_path(spark, "reports")
    for odd in (False, True):
        rows = derived.jacoco_reports(spark, d, odd)
        rows.write.mode("append").partitionBy("run").option("header", True).csv(path)
    found = readers.read_jacoco(spark, path, "run")
    return found.withColumn("run_id", F.col("report").cast("bigint"))


@query("jacoco_report_totals")
def jacoco_report_totals(spark: SparkSession, d: str) -> DataFrame:
    return coverage.jacoco_totals(_reports(spark, d), ["run_id"])


@query("jacoco_rejected_reports")
def jacoco_rejected_reports(spark: SparkSession, d: str) -> DataFrame:
    return coverage.rejected_reports(_reports(spark, d), ["run_id"])


@query("coverage_of_rejected_reports")
def coverage_of_rejected_reports(spark: SparkSession, d: str) -> DataFrame:
    """A passed run whose report has a rejected row failed to run."""
    results = flows.java_results(derived.runs(spark, d), _reports(spark, d), ["run_id"], ("task_id", "impl"))
    return results.select(*RUN_KEYS, "status", "error", "coverage.*")


@query("jacoco_totals")
def jacoco_totals(spark: SparkSession, d: str) -> DataFrame:
    return coverage.jacoco_totals(derived.jacoco(spark, d), ["run_id"])


def _covered(spark: SparkSession, d: str) -> DataFrame:
    return flows.java_results(derived.runs(spark, d), derived.jacoco(spark, d), ["run_id"], ("task_id", "impl"))


@query("attach_coverage")
def attach_coverage(spark: SparkSession, d: str) -> DataFrame:
    return _covered(spark, d).select(*RUN_KEYS, "status", "coverage.*")


@query("overall_coverage")
def overall_coverage(spark: SparkSession, d: str) -> DataFrame:
    return coverage.overall_coverage(_covered(spark, d))


@query("coverage_lines")
def coverage_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.coverage_lines(overall_coverage(spark, d))


# --- summaries -------------------------------------------------------------------------------------------------------------------


def _file_results(spark: SparkSession, d: str) -> DataFrame:
    return _gradle(spark, d).withColumn("file_name", F.concat("impl", F.lit(".java")))


@query("status_counts")
def status_counts(spark: SparkSession, d: str) -> DataFrame:
    return summary.status_counts(_gradle(spark, d))


@query("status_counts_by_task")
def status_counts_by_task(spark: SparkSession, d: str) -> DataFrame:
    return summary.status_counts(_gradle(spark, d), ["task_id"])


def _mixed_names(spark: SparkSession, d: str) -> DataFrame:
    """File names with lower-case letters and two-letter names among them."""
    number = F.col("run_id")
    name = F.when(number % 3 == 0, F.lower("impl")).when(number % 5 == 0, F.concat("impl", "impl")).otherwise(F.col("impl"))
    return _gradle(spark, d).withColumn("file_name", F.concat(name, F.lit(".java")))


@query("letter_files")
def letter_files(spark: SparkSession, d: str) -> DataFrame:
    return summary.letter_files(_mixed_names(spark, d)).select("run_id", "file_name")


@query("assign_cohort")
def assign_cohort(spark: SparkSession, d: str) -> DataFrame:
    return summary.assign_cohort(_mixed_names(spark, d)).select("run_id", "file_name", "status", "cohort")


@query("cohort_stats")
def cohort_stats(spark: SparkSession, d: str) -> DataFrame:
    return summary.cohort_stats(_file_results(spark, d))


@query("assign_cohort_ranges")
def assign_cohort_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Cohorts as a table of overlapping ranges."""
    assigned = ranges.assign_ranges(_gradle(spark, d), derived.cohort_ranges(spark, d), "run_id")
    return assigned.select("run_id", "status", "cohort")


@query("cohort_stats_ranges")
def cohort_stats_ranges(spark: SparkSession, d: str) -> DataFrame:
    return ranges.range_stats(_gradle(spark, d), derived.cohort_ranges(spark, d), "run_id")


@query("all_figures")
def all_figures(spark: SparkSession, d: str) -> DataFrame:
    """Task, cohort and overall figures with coverage, from one pass."""
    return summary.all_figures(_covered(spark, d).withColumn("file_name", F.concat("impl", F.lit(".java"))))


@query("cohort_pass_rates")
def cohort_pass_rates(spark: SparkSession, d: str) -> DataFrame:
    return flows.pass_rates(derived.runs(spark, d), RUN_KEYS)


@query("latest_result")
def latest_result(spark: SparkSession, d: str) -> DataFrame:
    return summary.last_writer_wins(_gradle(spark, d), ["task_id", "impl"], ["run_id"])


@query("latest_result_merged")
def latest_result_merged(spark: SparkSession, d: str) -> DataFrame:
    """The newest results by merging batches, later ones first, and one of them twice."""
    results = _gradle(spark, d)
    kept = store.NewestTable(spark, scratch_path(spark, "newest"), ["task_id", "impl"], ["run_id"], 16)
    for batch, part in (("late", F.col("run_id") % 3 == 2), ("early", F.col("run_id") % 3 == 0), ("middle", F.col("run_id") % 3 == 1)):
        kept.merge(results.where(part), batch)
    kept.merge(results.where(F.col("run_id") % 3 == 1), "middle")
    return kept.read(results.schema)


@query("log_history")
def log_history(spark: SparkSession, d: str) -> DataFrame:
    entries = _gradle(spark, d).select("impl", "run_id", "status")
    return summary.log_history(entries, ["impl"], "run_id")


@query("log_totals")
def log_totals(spark: SparkSession, d: str) -> DataFrame:
    return summary.log_totals(_gradle(spark, d), ["impl"], "run_id")


@query("summary_lines")
def summary_lines(spark: SparkSession, d: str) -> DataFrame:
    return reports.summary_lines(_file_results(spark, d), "run_id")


# --- written and read back ------------------------------------------------------------------------------------------------------


@query("write_programs")
def write_programs(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "programs")
    writers.write_programs(render.render_all(_decoded(spark, d)), path)
    return spark.read.parquet(path).select("task_id", "variant", "language", "file_name", "source")


@query("write_reports")
def write_reports(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "reports")
    reported = reports.java_report(_file_results(spark, d), F.lit("1970-01-01 00:00:00"))
    writers.write_reports(reported, path, ("run_id", "report_file"))
    return spark.read.parquet(path).select("run_id", "report_file", F.col("value").alias("report"))


@query("write_summary")
def write_summary(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "summary")
    writers.write_summary(summary_lines(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("write_coverage")
def write_coverage(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "coverage")
    writers.write_coverage(coverage_lines(spark, d), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("append_logs")
def append_logs(spark: SparkSession, d: str) -> DataFrame:
    """Compile logs first, run logs appended to the same targets."""
    path = scratch_path(spark, "logs")
    entries = derived.runs(spark, d).select("run_id", "phase", "stdout", F.concat("impl", F.lit("_tests")).alias("target"))
    for phase in ("compile", "run"):
        writers.append_logs(entries.where(F.col("phase") == phase), path)
    return spark.read.parquet(path).select("run_id", "phase", "stdout", "target")


@query("append_batches")
def append_batches(spark: SparkSession, d: str) -> DataFrame:
    """Logs in batches: one of them twice, as after a failure, and one that was never finished."""
    entries = derived.runs(spark, d).select("run_id", "phase", "stdout", F.concat("impl", F.lit("_tests")).alias("target"))
    log = store.BatchLog(spark, scratch_path(spark, "batches"))
    for phase in ("compile", "run", "run"):
        log.append(entries.where(F.col("phase") == phase), phase)
    log.write(entries, "unfinished")
    return log.read("run_id bigint, phase string, stdout string, target string")


# --- logs and texts --------------------------------------------------------------------------------------------------------------


def _log_query(change: Callable[[str], Column], out: str) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return derived.logs(spark, d).select("run_id", change("log").alias(out))

    return run


query("strip_ansi")(_log_query(lambda c: text.strip_ansi(c, "py"), "clean"))
query("strip_ansi_js")(_log_query(lambda c: text.strip_ansi(c, "js"), "clean"))
query("log_line_filter")(_log_query(lambda c: text.drop_lines(c, "/Users/me/"), "kept"))


@query("report_lines")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    marked = F.replace(F.col("log"), F.lit(" the "), F.lit(" \n \x1b[32m✓\x1b[0m   "))
    marked = F.replace(marked, F.lit(" of "), F.lit("\t\n✓"))
    return derived.logs(spark, d).select("run_id", text.report_lines(marked).alias("lines"))


@query("report_line_table")
def report_line_table(spark: SparkSession, d: str) -> DataFrame:
    lines = derived.logs(spark, d).select("run_id", F.posexplode(F.split("log", "\n", -1)).alias("pos", "line"))
    return reports.collect_reports(lines, ["run_id"], "pos")


@query("python_report")
def python_report(spark: SparkSession, d: str) -> DataFrame:
    named = derived.logs(spark, d).withColumn("script", F.concat(F.lit("src/m.v"), "run_id", F.lit(".py")))
    return reports.python_report(named, "script", "log", "log").select("run_id", "report")


@query("java_report")
def java_report(spark: SparkSession, d: str) -> DataFrame:
    reported = reports.java_report(_file_results(spark, d), F.lit("1970-01-01 00:00:00"))
    return reported.select("run_id", "report_file", "report")


@query("name_and_pad")
def name_and_pad(spark: SparkSession, d: str) -> DataFrame:
    docs = derived.table(spark, d, "documents")
    path = F.concat(F.lit("code/"), "source", F.lit(".java.x.js"), F.col("lang"), F.lit(".py"))
    share = F.col("doc_id") / F.col("n_chars") * 100
    status = F.when(F.col("doc_id") % 3 == 0, "PASSED").when(F.col("doc_id") % 3 == 1, "FAILED").otherwise("NOT_RUN")
    return docs.select(
        "doc_id",
        text.file_stem(path, "java").alias("stem_java"),
        text.file_stem(path, "python").alias("stem_python"),
        text.file_stem(path, "js").alias("stem_js"),
        text.file_stem(path, "dir").alias("stem_dir"),
        text.pad_end("source", 20).alias("padded"),
        text.pad_end("text", 20).alias("whole"),
        text.pct2(share).alias("pct"),
        text.status_icon(status).alias("icon"),
        text.status_icon(status, "text").alias("icon_text"),
        text.null_if_blank(F.when(F.col("doc_id") % 2 == 0, F.lit(" \t\xa0")).otherwise(F.col("lang"))).alias("filled"),
    )


def all_queries() -> dict[str, Query]:
    return dict(QUERIES)


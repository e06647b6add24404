"""Verdicts from process outcomes, and their way back to the tasks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import null_if_blank, py_strip
from codetrials.schemas import RUN_LIMIT_S, VARIANTS

TIMEOUT_TEXT = "Execution timed out."
KEYS = ("task_id", "impl")


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _late(runs: DataFrame, limit_s: float) -> Column:
    """Timed out: by the flag, or by a measured ``duration_s`` where the table has one."""
    late = F.coalesce(F.col("timed_out"), F.lit(False))
    if "duration_s" in runs.columns:
        late = late | F.coalesce(F.col("duration_s") > limit_s, F.lit(False))
    return late


def _run_verdict(late: Column, returncode: Column) -> Column:
    return F.when(late, "TIMEOUT").when(returncode == 0, "PASS").when(returncode.isNotNull(), "FAIL")


def classify_compiled(
    runs: DataFrame,
    keys: Sequence[str] = KEYS,
    order: str = "ts",
    limit_s: float = RUN_LIMIT_S,
    with_output: bool = True,
) -> DataFrame:
    """C++ and Java programs: ``(*keys, status, output)``, or ``(*keys, status)`` with ``with_output=False``, which
    reads no program output and aggregates in a hash table.

    A failed compilation decides alone and shows only its error text; the time limit holds for the run.  The last
    outcome of a phase (by ``order``) counts.  Compile and run rows meet in one aggregation that combines before the
    shuffle, so a key with very many outcomes sends one row per task.
    """
    late = _late(runs, limit_s)
    if not with_output:
        compiling, running = F.col("phase") == "compile", F.col("phase") == "run"
        last = runs.groupBy(*keys).agg(
            F.max_by("returncode", F.when(compiling, F.col(order))).alias("_built"),
            F.max_by("returncode", F.when(running, F.col(order))).alias("_code"),
            F.max_by(late, F.when(running, F.col(order))).alias("_late"),
        )
        broken = F.coalesce(F.col("_built") != 0, F.lit(False))
        status = F.when(broken, "COMPILE ERROR").otherwise(_run_verdict(F.col("_late"), F.col("_code")))
        return last.select(*keys, status.alias("status"))
    return judge_outcomes(last_outcomes(runs, keys, order, limit_s), keys)


def last_outcomes(
    runs: DataFrame, keys: Sequence[str] = KEYS, order: str = "ts", limit_s: float = RUN_LIMIT_S
) -> DataFrame:
    """``(*keys, _compiled, _ran)``: the last outcome of each phase with its output, NULL where there is none."""
    late = _late(runs, limit_s)
    compiled = F.max(
        F.when(
            F.col("phase") == "compile",
            F.struct(
                F.col(order).alias("order"),
                F.col("returncode"),
                F.when(F.col("returncode") != 0, _text("stderr")).alias("output"),
            ),
        )
    )
    ran = F.max(
        F.when(
            F.col("phase") == "run",
            F.struct(
                F.col(order).alias("order"),
                F.col("returncode"),
                late.alias("late"),
                F.when(~late, F.concat(_text("stdout"), _text("stderr"))).alias("output"),
            ),
        )
    )
    return runs.groupBy(*keys).agg(compiled.alias("_compiled"), ran.alias("_ran"))


def judge_outcomes(both: DataFrame, keys: Sequence[str] = KEYS, builds: Column | None = None) -> DataFrame:
    """``(*keys, status, output)`` of :func:`last_outcomes`; where ``builds`` is false a compile phase counts for
    nothing."""
    broken = F.coalesce(F.col("_compiled.returncode") != 0, F.lit(False))
    if builds is not None:
        broken = broken & builds
    late = F.col("_ran.late")
    return both.select(
        *keys,
        F.when(broken, "COMPILE ERROR")
        .otherwise(_run_verdict(late, F.col("_ran.returncode")))
        .alias("status"),
        F.when(broken, F.col("_compiled.output"))
        .when(late, TIMEOUT_TEXT)
        .otherwise(F.col("_ran.output"))
        .alias("output"),
    )


def classify_interpreted(
    runs: DataFrame, keys: Sequence[str] = KEYS, limit_s: float = RUN_LIMIT_S
) -> DataFrame:
    """Python and JavaScript programs: ``(*keys, status, output)``, one row per run."""
    late = _late(runs, limit_s)
    return runs.where(F.col("phase") == "run").select(
        *keys,
        _run_verdict(late, F.col("returncode")).alias("status"),
        F.when(late, TIMEOUT_TEXT).otherwise(F.concat(_text("stdout"), _text("stderr"))).alias("output"),
    )


def classify_gradle(
    runs: DataFrame, keys: Sequence[str] = KEYS, platform: str = "mac", keep: Sequence[str] = ()
) -> DataFrame:
    """Java test runs: ``(*keys, *keep, status, output, error)``.

    ``error:`` anywhere in the output means that compilation failed, whatever the return code.  Optional columns:
    ``exception`` (text of an error that stopped the run) and ``wrapper_failed`` (the outcome is that of the wrapper
    set-up: an error on ``mac``, judged by its text like a test run on ``windows``).
    """
    if platform not in ("mac", "windows"):
        raise ValueError(f"unknown platform {platform!r}")
    output = F.concat(_text("stdout"), _text("stderr"))
    code = F.col("returncode").cast("string")
    stopped = F.col("exception") if "exception" in runs.columns else F.lit(None).cast("string")
    if platform == "mac" and "wrapper_failed" in runs.columns:
        message = F.concat(
            F.lit("Command '['gradle', 'wrapper']' returned non-zero exit status "), code, F.lit(".")
        )
        stopped = F.coalesce(stopped, F.when(F.col("wrapper_failed"), message))
    uncompiled = F.contains(output, F.lit("compileJava FAILED")) | F.contains(output, F.lit("error:"))
    return runs.where(F.col("phase") == "run").select(
        *keys,
        *keep,
        F.when(stopped.isNotNull() | uncompiled, "FAILED_TO_RUN")
        .when(F.col("returncode") == 0, "PASSED")
        .otherwise("FAILED")
        .alias("status"),
        F.when(stopped.isNull(), output).otherwise("").alias("output"),
        F.when(stopped.isNotNull(), stopped)
        .when(uncompiled, "Compilation failed")
        .when(F.coalesce(F.col("returncode") != 0, F.lit(True)), F.concat(
            F.lit("Tests failed with return code: "), F.coalesce(code, F.lit("None"))
        ))
        .alias("error"),
    )


def _builds(runs: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keys whose last build succeeded, as in ``classify_compiled``."""
    last = runs.where(F.col("phase") == "compile").groupBy(*keys).agg(F.max_by("returncode", order).alias("_code"))
    return last.where(F.col("_code") == 0).select(*keys)


def gate_on_build(runs: DataFrame, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """Run rows whose last build succeeded."""
    return runs.where(F.col("phase") == "run").join(_builds(runs, keys, order), list(keys), "left_semi")


def skipped_by_build(runs: DataFrame, keys: Sequence[str] = KEYS, order: str = "ts") -> DataFrame:
    """Run rows to leave out: their last build failed or is missing."""
    return runs.where(F.col("phase") == "run").join(_builds(runs, keys, order), list(keys), "left_anti")


def attach_verdicts(tasks: DataFrame, verdicts: DataFrame, key: str = "task_id", *, order: str) -> DataFrame:
    """Tasks plus status and output of both variants.

    ``verdicts(key, variant, status, output)``; where a variant was run again, the last one by ``order`` counts.
    They are combined to one row per key before they meet the tasks.
    """
    pivoted = verdicts.groupBy(key).agg(
        *[
            F.max(F.when(F.col("variant") == v, F.struct(F.col(order).alias("order"), "status", "output"))).alias(f"_{v}")
            for v in VARIANTS
        ]
    )
    added = []
    for v in VARIANTS:
        added.append(py_strip(F.col(f"_{v}.status")).alias(f"{v}_test_status"))
        added.append(null_if_blank(F.col(f"_{v}.output")).alias(f"{v}_test_output"))
    return tasks.join(pivoted, key, "left").select(*tasks.columns, *added)


def discriminating_tasks(attached: DataFrame) -> DataFrame:
    """Tasks whose tests accept the canonical solution and reject the incorrect one."""
    return attached.where((F.col("ir_test_status") == "PASS") & (F.col("incs_test_status") != "PASS"))

"""Removal of C++ main functions from files kept as tables of lines.

The remover is a machine that reads line after line.  Outside a main function it keeps them; a header puts it inside with
brace count 0; inside it counts braces and drops the lines up to the one that ends the function.  A file of very many lines
is no one task's: it is cut into runs, and each run is reduced to its *transition function*, what it does to any state it
may be entered with.  These functions are few numbers each and compose associatively, so a prefix composition over the
runs of a file gives the state in which every run is entered, and a second pass over the lines applies it.

Without a header a run adds its net count, unless it ends the function: for a set of entry counts that is part of the
summary.  With a header in it, it leaves a state that does not depend on the entry.  The prefix composition is therefore a
prefix sum that starts anew at each run with a header, which windows over one row per run express.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetrials.operators.code import CPP_MAIN, brace_balance
from codetrials.operators.ordered import TEXT_BITS

MODES = ("faithful", "balanced")
BEFORE = Window.unboundedPreceding, -1
SO_FAR = Window.unboundedPreceding, Window.currentRow


def _marked(lines: DataFrame, seq: str, line: str, mode: str, bits: int | None) -> DataFrame:
    """Lines with ``_run``, ``_head`` (a header), ``_step`` (change of the count) and ``_mark``: a line that may end the
    function by itself (``faithful``), or that opens a brace (``balanced``)."""
    text = F.col(line)
    if mode == "balanced":
        step, mark = brace_balance(text), F.contains(text, F.lit("{"))
    else:
        start = F.ltrim(text, F.lit(" \t"))
        mark = F.startswith(start, F.lit("}"))
        step = F.when(F.startswith(start, F.lit("{")), 1).when(mark, -1).otherwise(0)
    run = F.lit(0).cast("bigint") if bits is None else F.shiftright(F.col(seq).cast("bigint"), bits)
    return lines.withColumns(
        {"_run": run, "_head": text.rlike(rf"\A{CPP_MAIN}").cast("int"), "_step": step.cast("bigint"), "_mark": mark}
    )


def _counted(marked: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Add ``_part`` (headers of the run so far), ``_sum`` (the count since its start) and ``_open`` (a mark since then)."""
    run = Window.partitionBy(*keys, "_run").orderBy(seq).rowsBetween(*SO_FAR)
    part = Window.partitionBy(*keys, "_run", "_part").orderBy(seq).rowsBetween(*SO_FAR)
    return marked.withColumn("_part", F.sum("_head").over(run)).withColumns(
        {"_sum": F.sum("_step").over(part), "_open": F.max("_mark").over(part)}
    )


def _ends(entry: Column, mode: str) -> Column:
    """Whether a line ends the function if its part was entered with this count.

    ``balanced``: once a brace has been opened, a count of 0 or less ends it; until then the count is not positive, so the
    entry count tells whether one was opened before.
    """
    now = entry + F.col("_sum")
    return (F.col("_open") | (entry > 0)) & (now <= 0) if mode == "balanced" else F.col("_mark") & (now == 0)


def transitions(counted: DataFrame, keys: Sequence[str], seq: str, mode: str) -> DataFrame:
    """``(*keys, _run, _resets, _net, _gone, ...)``: what each run does.

    ``_resets``: it has a header, and whatever it is entered with leaves it outside (``_gone``) or with count ``_net``.
    Otherwise it adds ``_net``, but is left outside from the entry counts in ``_falls`` (``faithful``), or from a positive
    one of at most ``_least`` and another of at most ``_least_open`` (``balanced``).
    """
    first = F.col("_part") == 0
    part = Window.partitionBy(*keys, "_run", "_part").orderBy(seq).rowsBetween(*SO_FAR)
    rows = counted.withColumn("_gone", F.max(_ends(F.lit(0), mode)).over(part))
    last = F.max(F.struct(F.col(seq), "_part", "_sum", "_gone")).alias("_last")
    if mode == "balanced":
        figures = [
            (-F.min(F.when(first, F.col("_sum")))).alias("_least"),
            (-F.min(F.when(first & F.col("_open"), F.col("_sum")))).alias("_least_open"),
        ]
    else:
        figures = [F.collect_set(F.when(first & F.col("_mark"), -F.col("_sum"))).alias("_falls")]
    return rows.groupBy(*keys, "_run").agg(last, *figures).select(
        *keys, "_run", (F.col("_last._part") > 0).alias("_resets"), F.col("_last._sum").alias("_net"),
        F.col("_last._gone").alias("_gone"), *[c for c in ("_least", "_least_open", "_falls") if (mode == "balanced") == c.startswith("_least")],
    )


def entered(functions: DataFrame, keys: Sequence[str], mode: str) -> DataFrame:
    """``(*keys, _run, _entry)``: the runs that are entered inside a main function, with the count there."""
    runs = Window.partitionBy(*keys).orderBy("_run").rowsBetween(*BEFORE)
    stretch = Window.partitionBy(*keys, "_stretch").orderBy("_run").rowsBetween(*BEFORE)
    left = F.last(F.when(F.col("_resets"), F.struct("_gone", "_net")), ignorenulls=True).over(runs)
    rows = functions.withColumns({"_left": left, "_stretch": F.coalesce(F.sum(F.col("_resets").cast("int")).over(runs), F.lit(0))})
    rows = rows.where(F.col("_left").isNotNull() & ~F.col("_left._gone"))
    # the run with the header stands in the stretch before
    added = F.coalesce(F.sum(F.when(~F.col("_resets"), F.col("_net"))).over(stretch), F.lit(0))
    rows = rows.withColumn("_entry", F.col("_left._net") + added)
    entry = F.col("_entry")
    if mode == "balanced":
        falls = F.when(entry > 0, entry <= F.col("_least")).otherwise(entry <= F.col("_least_open"))
    else:
        falls = F.array_contains("_falls", entry)
    rows = rows.withColumn("_out", F.coalesce(falls, F.lit(False)))
    return rows.withColumn("_past", F.max("_out").over(stretch)).where(~F.coalesce("_past", F.lit(False))).select(*keys, "_run", "_entry")


def remove_main_lines(
    lines: DataFrame, keys: Sequence[str], seq: str = "pos", line: str = "line", mode: str = "faithful", bits: int | None = TEXT_BITS
) -> DataFrame:
    """The lines ``(*keys, seq, line)`` that :func:`codetrials.operators.code.remove_main` keeps.

    ``seq`` is an integer, unique within its key, that orders the lines of a file.  ``bits`` sets the run: lines whose
    ``seq`` agree but for their last ``bits`` bits, one task's at most; ``None`` takes a file as one run.  A line is shuffled
    once, by file and run; the summaries come from a pass that reads the lines but shuffles only their marks.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}")
    keys = list(keys)
    marked = _marked(lines, seq, line, mode, bits)
    marks = _counted(marked.select(*keys, seq, "_run", "_head", "_step", "_mark"), keys, seq)
    if bits is None:
        inside = None
    else:
        inside = entered(transitions(marks, keys, seq, mode), keys, mode)
    whole = _counted(marked.select(*keys, seq, line, "_run", "_head", "_step", "_mark"), keys, seq)
    whole = whole.withColumn("_entry", F.lit(None).cast("bigint")) if inside is None else whole.join(inside, [*keys, "_run"], "left")
    entry = F.when(F.col("_part") > 0, F.lit(0).cast("bigint")).otherwise(F.col("_entry"))
    part = Window.partitionBy(*keys, "_run", "_part")
    ended = whole.withColumn("_entry", entry).withColumn("_end", F.min(F.when(_ends(F.col("_entry"), mode), F.col(seq))).over(part))
    kept = F.col("_entry").isNull() | F.coalesce(F.col(seq) > F.col("_end"), F.lit(False))
    return ended.where(kept).select(*keys, seq, line)

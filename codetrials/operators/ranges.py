"""Ranges as a table: which of very many, overlapping ranges hold a value, without a nested loop.

An interval index: a range of up to 2 ** level values is entered in the one or two bins of that width that it touches; a
value looks into one bin on each level that is in use.  So the join is on equal keys (level, bin), and an exact comparison
follows.  Only distinct values take part, which keeps a value that very many rows share from being looked up more than once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import ratio_pct

LEVELS = 62  # a range holds fewer than 2 ** 62 values


def _level(low: Column, high: Column) -> Column:
    """Bits of the width less one: 2 ** level is the least power of two that is no smaller than the width."""
    return F.when(high == low, 0).otherwise(F.length(F.bin(high - low)))


def matching_ranges(values: DataFrame, ranges: DataFrame, value: str, low: str = "low", high: str = "high") -> DataFrame:
    """The columns of ``ranges`` with each value of ``values`` that they hold, ends included.

    ``value`` is an integer column, whose name no column of ``ranges`` has.  A value in several ranges is several rows, one
    in none, or NULL, is no row; a range without values (``low`` above ``high``) or with a NULL end holds nothing.
    """
    first, last = F.col(low).cast("bigint"), F.col(high).cast("bigint")
    known = ranges.where(first <= last)
    level = _level(first, last)
    used = sorted(r[0] for r in known.select(level.alias("level")).distinct().collect())  # at most LEVELS + 1 numbers
    if used and used[-1] > LEVELS:
        raise ValueError(f"a range holds more than 2 ** {LEVELS} values")
    entries = known.select(F.struct(*ranges.columns).alias("_range"), first.alias("_low"), last.alias("_high"), level.alias("_level"))
    entries = entries.withColumn("_bin", F.explode(F.expr("sequence(shiftright(_low, _level), shiftright(_high, _level))")))
    looked = values.select(F.col(value).cast("bigint").alias("_value")).where("_value is not null").distinct()
    looked = looked.select("_value", F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>")).alias("_level"))
    looked = looked.withColumn("_bin", F.expr("shiftright(_value, _level)"))
    found = looked.join(entries, ["_level", "_bin"]).where(F.col("_value").between(F.col("_low"), F.col("_high")))
    return found.select(F.col("_value").alias(value), "_range.*")


def assign_ranges(
    rows: DataFrame, ranges: DataFrame, value: str, name: str = "cohort", low: str = "low", high: str = "high"
) -> DataFrame:
    """``rows`` with the ``name`` of each range that holds their ``value``; NULL where none does."""
    found = matching_ranges(rows, ranges.select(name, low, high), value, low, high)
    found = found.select(F.col(value).alias("_value"), F.col(name).alias("_name"))
    joined = rows.join(found, F.col(value).cast("bigint") == F.col("_value"), "left")
    return joined.select(*[rows[c] for c in rows.columns], F.col("_name").alias(name))


def range_stats(
    results: DataFrame, ranges: DataFrame, value: str, name: str = "cohort", low: str = "low", high: str = "high"
) -> DataFrame:
    """``(cohort, total, passed, failed, pass_pct, fail_pct)`` of every range, a row of zeros for an empty one.

    The results are counted per value before they meet the ranges; several ranges of one name are one cohort, and a
    result in two of them counts once.
    """
    status = F.col("status")
    by_value = results.groupBy(F.col(value).cast("bigint").alias("_value")).agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if(status == "PASSED").alias("_passed"),
        F.count_if(status.isin("FAILED", "FAILED_TO_RUN")).alias("_failed"),
    )
    held = matching_ranges(by_value, ranges.select(name, low, high), "_value", low, high).select("_value", name).distinct()
    sums = held.join(by_value, "_value").groupBy(name).agg(
        *[F.sum(f"_{c}").alias(c) for c in ("total", "passed", "failed")]
    )
    return (
        ranges.select(name)
        .distinct()
        .join(sums, name, "left")
        .select(name, *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "passed", "failed")])
        .select("*", ratio_pct("passed", "total").alias("pass_pct"), ratio_pct("failed", "total").alias("fail_pct"))
    )

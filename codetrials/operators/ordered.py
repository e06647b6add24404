"""Order-dependent operators that survive a key with very many rows.

A plain ``Window.partitionBy(key).orderBy(seq)`` puts a whole key into one task.  The functions here cut each key into
runs of ``2 ** bits`` consecutive sequence numbers, work inside the runs, and carry one row per run over to the next.
The heavy shuffle is on ``(key, run)``, so a run holds a bounded number of rows however large its key is; only the
one-row summaries, made before the shuffle, are brought together per key.  ``seq`` must be an integer that is unique
within its key.

The summaries take a second read of the input, and are few only where a run holds many rows of a key: choose ``bits``
as large as a task can take.  Where no key can be large, ``bits=None`` does without: the same result from one plain
window.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLIM_BITS = 20  # rows of a few numbers: about a million of them in a run
TEXT_BITS = 16  # rows with texts
RUN = "_run"


def with_run(df: DataFrame, seq: str, bits: int = SLIM_BITS) -> DataFrame:
    return df.withColumn(RUN, F.shiftright(F.col(seq).cast("bigint"), bits))


def lag_within(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, out: str, bits: int | None = SLIM_BITS
) -> DataFrame:
    """Add ``out``: ``value`` of the previous row of the same key in ``seq`` order (NULL for the first).

    A numeric ``value`` keeps the summaries in hash aggregation; text would make them sort.
    """
    keys = list(keys)
    if bits is None:
        return df.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(seq)))
    runs = with_run(df, seq, bits)
    carry = (
        runs.groupBy(*keys, RUN)
        .agg(F.max_by(value, seq).alias("_last"))
        .withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(RUN)))
        .where(F.col("_carry").isNotNull())
        .select(*keys, RUN, "_carry")
    )
    inside = Window.partitionBy(*keys, RUN).orderBy(seq)
    local = runs.withColumn("_first", F.row_number().over(inside) == 1).withColumn(
        "_prev", F.lag(value).over(inside)
    )
    return (
        local.join(carry, [*keys, RUN], "left")
        .withColumn(out, F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_prev")))
        .drop(RUN, "_first", "_prev", "_carry")
    )


def sum_before(
    df: DataFrame, keys: Sequence[str], seq: str, value: str, out: str, bits: int | None = SLIM_BITS
) -> DataFrame:
    """Add ``out``: the sum of ``value`` over all earlier rows of the same key (0 for the first)."""
    keys = list(keys)
    zero = F.lit(0).cast("bigint")
    before = Window.unboundedPreceding, -1
    if bits is None:
        whole = Window.partitionBy(*keys).orderBy(seq).rowsBetween(*before)
        return df.withColumn(out, F.coalesce(F.sum(value).over(whole), zero))
    runs = with_run(df, seq, bits)
    earlier = Window.partitionBy(*keys).orderBy(RUN).rowsBetween(*before)
    offsets = (
        runs.groupBy(*keys, RUN)
        .agg(F.sum(value).alias("_total"))
        .withColumn("_offset", F.sum("_total").over(earlier))
        .where(F.coalesce(F.col("_offset"), F.lit(0)) != 0)
        .select(*keys, RUN, "_offset")
    )
    inside = Window.partitionBy(*keys, RUN).orderBy(seq).rowsBetween(*before)
    local = runs.withColumn("_inside", F.coalesce(F.sum(value).over(inside), zero))
    return (
        local.join(offsets, [*keys, RUN], "left")
        .withColumn(out, F.col("_inside") + F.coalesce(F.col("_offset"), zero))
        .drop(RUN, "_inside", "_offset")
    )


def newest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Last writer wins: the row with the largest ``order`` per key.

    Catalyst turns ``row_number() = 1`` into a group limit that runs before the shuffle too, so each task sends at
    most one row per key.
    """
    by = [F.col(o).desc() if isinstance(o, str) else o.desc() for o in order]
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")

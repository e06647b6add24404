"""Writers of task records, programs, reports, summaries and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def task_json(tasks: DataFrame) -> DataFrame:
    """One column ``value``: each record as JSON with only its filled fields."""
    return tasks.select(F.to_json(F.struct(*tasks.columns), {"ignoreNullFields": "true"}).alias("value"))


def write_tasks(tasks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Task records as JSON lines."""
    task_json(tasks).write.mode(mode).text(path)


def write_routed(rows: DataFrame, path: str, reason: str = "reject_reason", mode: str = "errorifexists") -> dict[str, int]:
    """Good and rejected rows in one write, in folders by ``outcome`` (``usable``, ``rejected``), and how many of each.

    The counts are observed while the rows pass, so whatever made them (decoding, checks) runs once for both sides.
    """
    rejected = F.col(reason).isNotNull()
    seen = Observation()
    counts = [F.count_if(~rejected).alias("usable"), F.count_if(rejected).alias("rejected")]
    routed = rows.observe(seen, *counts).withColumn("outcome", F.when(rejected, "rejected").otherwise("usable"))
    routed.write.mode(mode).partitionBy("outcome").parquet(path)
    return seen.get


def write_programs(programs: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rendered programs, partitioned by language (a closed list, so the number of folders is bounded)."""
    programs.write.mode(mode).partitionBy("language").parquet(path)


def write_reports(
    reports: DataFrame, path: str, keys: Sequence[str] = ("task_id", "impl"), text: str = "report",
    layout: str = "table", mode: str = "errorifexists",
) -> None:
    """Report texts.  ``table`` keeps them as rows; ``files`` makes one folder per key, for exports of few tasks.

    Every row is written: a NULL report is a NULL in the table, and an empty file.
    """
    rows = reports.select(*keys, F.col(text).alias("value"))
    if layout == "table":
        rows.write.mode(mode).parquet(path)
    elif layout == "files":
        filled = rows.withColumn("value", F.coalesce("value", F.lit("")))
        filled.write.mode(mode).partitionBy(*keys).option("lineSep", "\n").text(path)
    else:
        raise ValueError(f"unknown layout {layout!r}")


def write_lines(lines: DataFrame, path: str, order: Sequence[str] = ("section", "seq"), mode: str = "errorifexists") -> None:
    """Summary and coverage lines as text whose part files, read in name order, are in line order.

    The lines are sorted by range, so a summary with one line per file of a large corpus is written by many tasks.
    """
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode(mode).text(path)


def write_summary(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_lines(lines, path, ("section", "seq"), mode)


def write_coverage(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    write_lines(lines, path, ("section", "seq"), mode)


def append_logs(logs: DataFrame, path: str, partition: str = "target", fresh: bool = False, salts: int = 4) -> None:
    """Logs per target: added to what is there, or, with ``fresh``, in place of the partitions they belong to.

    Rows are dealt out by target and a salt from the row, so an append writes at most ``salts`` files per target
    whatever the number of its tasks, and a target with very many rows is not one task's.  Raise ``salts`` for hot
    targets.
    """
    salt = F.pmod(F.xxhash64(*logs.columns), F.lit(salts))
    writer = logs.repartition(F.col(partition), salt).write.partitionBy(partition)
    if fresh:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    else:
        writer.mode("append").parquet(path)

"""Incremental secret scans over a ledger of content-addressed texts, in DataFrame functions alone.

A version of a file is a row (path, text).  Its blob is the SHA-256 of its text.  The ledger, a folder with two tables,
holds which blobs have been scanned under which version of the rules, and what was found in them.  A scan takes the
blobs without an entry, one row of each, and appends; findings are then joined back to every path that has the blob.  A
new version of the rules is a new hash, so all blobs are unseen under it.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codetrials.llm.names import unused
from codetrials.plans.scratch import scratch_path


@dataclass(frozen=True)
class Rule:
    """``group``: of the match, must have ``least`` characters, or the match is dropped."""

    kind: str
    pattern: str
    group: int
    least: int
    base: bool


#: Kinds in the order in which spans of one start are listed, and their patterns.
BASE_RULES = [
    Rule(
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        6,
        True,
    ),
    Rule("access", r"(AKIA[A-Z0-9]+)", 1, 20, True),
    Rule("hex", r"([0-9a-f]{24,})", 1, 24, True),  # a maximal run, as with +, but without a match for every short one
]
MORE_RULES = [
    Rule("pem", r"(-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----)", 1, 1, False),
    Rule("github", r"(gh[opsur]_[A-Za-z0-9]{36,})", 1, 1, False),
    Rule("jwt", r"(eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})", 1, 1, False),
]
RULES = BASE_RULES + MORE_RULES
FINDINGS = "blob string, rules string, kind int, start long, stop long"
SCANNED = "blob string, rules string"
SALTS = 16  # tasks among which the paths of one blob are dealt out


def version_of(rules: list[Rule]) -> str:
    return hashlib.sha256(json.dumps([asdict(r) for r in rules]).encode()).hexdigest()[:16]


def blob_of(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def found_in(texts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(blob, kind, start, stop) of the matches in (blob, text), leftmost and not overlapping for each kind; in code
    points.

    What stands between the matches, and the matches, are as long as the text, so a running sum gives the places.
    """
    rows = None
    for k, rule in enumerate(rules):
        pattern = F.lit(rule.pattern)
        one = texts.where(F.col("text").rlike(rule.pattern)).select(
            "blob",
            F.lit(k).alias("kind"),
            F.posexplode(
                F.arrays_zip(
                    F.split("text", rule.pattern, -1).alias("gap"),
                    F.regexp_extract_all("text", pattern, F.lit(0)).alias("match"),
                    F.regexp_extract_all("text", pattern, F.lit(rule.group)).alias("value"),
                )
            ).alias("nth", "m"),
        )
        one = one.where("m.match is not null").select(
            "blob", "kind", "nth", F.length("m.gap").alias("gap"), F.length("m.match").alias("size"),
            (F.length("m.value") >= rule.least).alias("good"),
        )
        rows = one if rows is None else rows.unionByName(one)
    so_far = Window.partitionBy("blob", "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("stop", F.sum(F.col("gap") + F.col("size")).over(so_far).cast("long"))
    return placed.where("good").select("blob", "kind", (F.col("stop") - F.col("size")).alias("start"), "stop")


class Ledger:
    """The tables of a folder that all executors reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            fields = [f.strip().split() for f in schema.split(",")]
            return self.spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in fields])

    def findings(self, rules: list[Rule] = RULES) -> DataFrame:
        return self._read("findings", FINDINGS).where(F.col("rules") == version_of(rules))

    def scanned(self, rules: list[Rule] = RULES) -> DataFrame:
        return self._read("scanned", SCANNED).where(F.col("rules") == version_of(rules))

    def unseen(self, versions: DataFrame, rules: list[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
        """(blob, path): a path of each blob that has no entry under these rules."""
        slim = versions.select(blob_of(F.col(text)).alias("blob"), F.col(path).alias("path"))
        return slim.groupBy("blob").agg(F.min("path").alias("path")).join(self.scanned(rules), "blob", "left_anti")

    def scan(self, versions: DataFrame, rules: list[Rule] = RULES, path: str = "doc_id", text: str = "text") -> None:
        """Scan the unseen blobs of (path, text) rows and append to the ledger.

        Findings are appended first: a scan that breaks off leaves blobs unseen, which the next one scans again, so
        readers take distinct findings.
        """
        new = self.unseen(versions, rules, path, text).select(F.col("blob").alias("b"), F.col("path").alias("p"))
        rows = versions.select(blob_of(F.col(text)).alias("blob"), F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
        # texts meet their blobs by path: copies are one blob, but as many paths
        texts = rows.join(new, F.col("path").eqNullSafe(F.col("p")) & (F.col("blob") == F.col("b")), "left_semi")
        any_rule = F.lit(False)
        for rule in rules:
            any_rule |= F.col("text").rlike(rule.pattern)
        suspects = scratch_path(self.spark, "suspects")
        texts.where(any_rule).select("blob", "text").dropDuplicates(["blob"]).write.parquet(suspects)  # the few texts that each rule reads again
        version = F.lit(version_of(rules)).alias("rules")
        found = found_in(self.spark.read.schema("blob string, text string").parquet(suspects), rules)
        entries = new.select(F.col("b").alias("blob"), version)
        marked = scratch_path(self.spark, "entries")
        entries.write.parquet(marked)
        found.select("blob", version, "kind", "start", "stop").write.mode("append").parquet(f"{self.folder}/findings")
        self.spark.read.schema(SCANNED).parquet(marked).write.mode("append").parquet(f"{self.folder}/scanned")

    def of_blobs(self, rules: list[Rule] = RULES) -> DataFrame:
        """One row per blob with findings: a count for each kind, base spans and all spans as text."""
        kinds = F.array(*[F.lit(r.kind) for r in rules])
        spans = self.findings(rules).distinct()
        listed = lambda c: F.array_join(
            F.transform(c, lambda s: F.concat_ws(":", F.get(kinds, s.kind), s.start.cast("string"), s.stop.cast("string"))), ","
        )
        base = [k for k, r in enumerate(rules) if r.base]
        counts = [
            F.count_if(F.col("kind") == k).alias(f"n_{r.kind}") for k, r in enumerate(rules) if r.base
        ]
        grouped = spans.groupBy("blob").agg(*counts, F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("all"))
        return grouped.withColumn("base", listed(F.filter("all", lambda s: s.kind.isin(base)))).withColumn("spans", listed("all"))


def _dealt(path: Column) -> Column:
    """Deals out the many paths of one blob; the few blobs with findings meet each share of them."""
    return F.pmod(F.xxhash64(path), F.lit(SALTS)).cast("int").alias("salt")


def _to_all_shares(of_blobs: DataFrame) -> DataFrame:
    return of_blobs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def scan(versions: DataFrame, ledger: Ledger, rules: list[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """Scan what is unseen, then one row per path and text: counts of base findings, the hash of their spans, all spans.

    A null text is the empty blob.  A null path is a path; repeated rows each have a result.  An empty table gives an
    empty result.
    """
    ledger.scan(versions, rules, path, text)
    slim = versions.select(F.col(path), blob_of(F.col(text)).alias("blob"), _dealt(F.col(path)))
    of_path = slim.join(_to_all_shares(ledger.of_blobs(rules)), ["blob", "salt"], "left")
    counts = [F.coalesce(F.col(f"n_{r.kind}"), F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules if r.base]
    return of_path.select(
        path, *counts, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans")
    )


def clean(versions: DataFrame, ledger: Ledger, rules: list[Rule] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose blob has no finding of any of the rules, with the columns they came with, whatever their names."""
    ledger.scan(versions, rules, path, text)
    name = unused(versions, "found")
    found = _to_all_shares(ledger.findings(rules).select("blob").distinct()).select(F.struct("blob", "salt").alias(name))
    own = F.struct(blob_of(F.col(text)).alias("blob"), _dealt(F.col(path)))
    return versions.join(found, own == F.col(name), "left_anti")

"""Fixity audit of archives of records (WARC) by Merkle trees.

A leaf hashes one record; a node hashes its children, in order, with their lengths, and covers a range of byte offsets of
the archive.  Children are the sequence numbers that agree but for their last base-``fanout`` digit, so a lost record
changes its own branch only.  Two replicas are compared at the roots, and the audit descends level by level into the
branches whose hashes differ.

A node collects at most ``fanout`` children.  Rows that share an archive and a sequence number are one leaf, by sums of
their digests, which combine before the shuffle; offsets are running sums over runs of sequence numbers, so neither a hot
archive nor a hot number comes into one task.  Where the descent ends at a leaf of several records, its records are
compared by their digests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.operators.ordered import sum_before
from codetrials.plans.scratch import scratch_path

FANOUT = 16
LEVELS = 4  # above the leaves
PER_ARCHIVE = 1000
LEAVES = "archive long, seq long, length long, records long, hash string, start long"
NODES = "archive long, level int, node long, length long, records long, hash string"


def warc_record(url: Column, body: Column) -> Column:
    """The bytes of a WARC/1.0 response record, as text; a null url or body is empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archived(pages: DataFrame, per_archive: int = PER_ARCHIVE) -> DataFrame:
    """(archive, seq, record) of pages, ``per_archive`` consecutive ids to an archive; a null id is -1."""
    seq = F.coalesce(F.col("page_id").cast("long"), F.lit(-1))
    return pages.select(
        F.floor(seq / per_archive).cast("long").alias("archive"), seq.alias("seq"), warc_record(F.col("url"), F.col("html")).alias("record")
    )


def digests_of(records: DataFrame) -> DataFrame:
    """(archive, seq, length, digest) of every record, written to the shared folder."""
    path = scratch_path(records.sparkSession, "digests")
    length = F.octet_length("record").cast("long").alias("length")
    records.select("archive", "seq", length, F.sha2("record", 256).alias("digest")).write.parquet(path)
    return records.sparkSession.read.schema("archive long, seq long, length long, digest string").parquet(path)


def leaves_of(slim: DataFrame) -> DataFrame:
    """A leaf for each (archive, seq) of :func:`digests_of`, with the offset at which it starts; written to the shared
    folder."""
    spark = slim.sparkSession
    part = lambda k: F.conv(F.substring("digest", 1 + 16 * k, 16), 16, 10).cast("decimal(20,0)")
    sums = [F.sum(part(k)).cast("string").alias(f"part_{k}") for k in range(4)]
    leaves = (
        slim.groupBy("archive", "seq")
        .agg(F.sum("length").alias("length"), F.count("*").alias("records"), *sums)
        .withColumn("hash", F.sha2(F.concat_ws(":", "records", "length", *[f"part_{k}" for k in range(4)]), 256))
        .drop(*[f"part_{k}" for k in range(4)])
    )
    path = scratch_path(spark, "leaves")
    leaves.write.parquet(path)
    kept = spark.read.schema("archive long, seq long, length long, records long, hash string").parquet(path)
    return sum_before(kept, ["archive"], "seq", "length", "start")


class Tree:
    """The levels of the trees of all archives: 0 are the leaves, the last are the roots."""

    def __init__(self, records: DataFrame, fanout: int = FANOUT, levels: int = LEVELS):
        spark = records.sparkSession
        self.fanout = fanout
        self.digests = digests_of(records)
        self.leaves = leaves_of(self.digests)
        below = self.leaves.select(
            "archive", F.lit(0).alias("level"), F.col("seq").alias("node"), "length", "records", "hash"
        )
        self.levels = [below]
        for k in range(1, levels + 1):
            parent = F.floor(F.col("node") / fanout).cast("long") if k < levels else F.lit(0).cast("long")
            rows = below.groupBy("archive", parent.alias("parent"))
            if k == levels:
                # the root's children may be many: their hashes are summed like the records of a leaf
                part = lambda j: F.sum(F.conv(F.substring(F.sha2(F.concat_ws(":", "node", "hash"), 256), 1 + 16 * j, 16), 16, 10).cast("decimal(20,0)"))
                digest = F.sha2(F.concat_ws(":", *[part(j).cast("string") for j in range(4)]), 256)
            else:
                child = F.struct("node", "length", "hash")
                listed = F.transform(F.array_sort(F.collect_list(child)), lambda c: F.concat_ws(":", c["node"], c["length"], c["hash"]))
                digest = F.sha2(F.array_join(listed, ","), 256)
            level = rows.agg(F.sum("length").alias("length"), F.sum("records").alias("records"), digest.alias("hash")).select(
                "archive", F.lit(k).alias("level"), F.col("parent").alias("node"), "length", "records", "hash"
            )
            path = scratch_path(spark, f"level-{k}")
            level.write.parquet(path)
            below = spark.read.schema(NODES).parquet(path)
            self.levels.append(below)

    def roots(self) -> DataFrame:
        return self.levels[-1].select("archive", "hash", "records", "length")


def audit(one: Tree, two: Tree) -> DataFrame:
    """One row per damaged record: ``changed``, ``missing`` (in the second replica) or ``extra``, with its offset range in
    either replica (null where it is absent).

    ``record`` is null where the archive and number tell the record.  Several records of one archive and number are told
    by their SHA-256, which is there then, as often as one replica has more of it than the other: such a record is
    missing or extra, and the offsets are those of all records of the number.  Replicas that are equal give no row; an
    empty replica misses, or adds, every record.
    """
    if one.fanout != two.fanout or len(one.levels) != len(two.levels):
        raise ValueError("trees of different shape")
    differing = None
    for k in range(len(one.levels) - 1, -1, -1):
        columns = ["archive", "node", *["records"] * (k == 0)]
        sides = [
            t.levels[k].select(*columns, F.col("hash").alias(f"hash_{n}")).withColumnsRenamed({"records": f"records_{n}"}) for n, t in ((1, one), (2, two))
        ]
        if differing is not None:
            parent = F.floor(F.col("node") / one.fanout).cast("long") if k < len(one.levels) - 2 else F.lit(0).cast("long")
            sides = [
                s.withColumn("parent", parent).join(differing, ["archive", "parent"], "left_semi").drop("parent") for s in sides
            ]
        both = sides[0].join(sides[1], ["archive", "node"], "full_outer").where(~F.col("hash_1").eqNullSafe(F.col("hash_2")))
        differing = both.select("archive", F.col("node").alias("parent"))
    several = (F.coalesce("records_1", F.lit(0)) > 1) | (F.coalesce("records_2", F.lit(0)) > 1)
    path = scratch_path(one.leaves.sparkSession, "differing")
    status = F.when(F.col("hash_2").isNull(), "missing").when(F.col("hash_1").isNull(), "extra").otherwise("changed")
    both.select("archive", F.col("node").alias("seq"), status.alias("status"), several.alias("several")).write.parquet(path)
    leaves = one.leaves.sparkSession.read.schema("archive long, seq long, status string, several boolean").parquet(path)
    alone = leaves.where("not several").select("archive", "seq", "status", F.lit(None).cast("string").alias("record"))
    crowded = leaves.where("several").select("archive", "seq")
    counts = None
    for tree, sign in ((one, 1), (two, -1)):
        own = tree.digests.join(crowded, ["archive", "seq"], "left_semi").select("archive", "seq", "digest", F.lit(sign).alias("n"))
        counts = own if counts is None else counts.unionByName(own)
    more = counts.groupBy("archive", "seq", "digest").agg(F.sum("n").alias("n")).where("n <> 0")
    each = more.select(
        "archive", "seq", F.when(F.col("n") > 0, "missing").otherwise("extra").alias("status"), F.col("digest").alias("record"),
        F.explode(F.sequence(F.lit(1).cast("long"), F.abs("n"))).alias("copy"),
    ).drop("copy")
    damaged = alone.unionByName(each)
    for n, tree in ((1, one), (2, two)):
        place = tree.leaves.select(
            "archive", "seq", F.col("start").alias(f"start_{n}"), (F.col("start") + F.col("length")).alias(f"stop_{n}")
        )
        damaged = damaged.join(place, ["archive", "seq"], "left")
    return damaged

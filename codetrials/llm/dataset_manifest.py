"""A Merkle manifest of a dataset: a tree per source, a tree over the sources, and a proof for every row.

A leaf hashes one row.  Every ``fanout`` consecutive nodes hash to their parent by a slot pivot: conditional aggregates
spread the children into one column per slot, the concatenated columns are hashed, and the columns but a child's own are
its siblings.  A source's tree ends with one node, its subroot; the subroots, in the order of their sources, are the
leaves of one more tree, whose last node is the root.

Positions come from a range partitioning of slim rows by (source, order, leaf, row): no source, no id and no group of
equal rows is brought together, whatever its share.  A parent has at most ``fanout`` children, so no group is larger.  Each
level is a written table, a sixteenth of the one below.  Proofs go down from the root; what a row inherits travels with
its parent, once for ``fanout`` rows, and the proof itself is put together and hashed in the row.

Defined cases: a null field is ``-`` in its leaf.  Null sources come first, and so do null ids.  Rows of one id stand in
the order of their leaves; equal rows take consecutive places, and each has the proof of its own place.  A source of one
row has the leaf as subroot, and a dataset of one source has that subroot as root.  An empty table gives no rows.  Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetrials.plans.scratch import scratch_path

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 16
STEPS = "array<struct<left:string,right:string>>"


def field(value: Column) -> Column:
    """``-`` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(parts: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*parts), 256)


def group_of(value: Column) -> Column:
    """A key that is never null and sorts as the value does, null first."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), value.cast("string")))


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def placed(nodes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``place``, from 0 within ``grp`` in ``order`` (which must be unique there), and ``size``, the rows of the group."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(nodes.repartitionByRange(parts, "grp", *order).withColumn("part", F.spark_partition_id()), "dealt")
    by_part = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("grp", "part").agg(F.count("*").alias("n"))
    begins = counts.select(
        "grp", "part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("begin"), F.sum("n").over(Window.partitionBy("grp")).alias("size")
    )
    inside = F.row_number().over(Window.partitionBy("grp", "part").orderBy(*order)) - 1
    return dealt.withColumn("inside", inside).join(begins, ["grp", "part"]).withColumn("place", F.col("begin") + F.col("inside")).drop("part", "inside", "begin")


class Forest:
    """The trees of all groups of ``leaves`` (grp, place, size, hash, ...), level by level; the leaves are level 0.

    ``levels[k]`` has a row per node: grp, place, size (nodes of the group on this level), hash and the slot columns.
    """

    def __init__(self, leaves: DataFrame, fanout: int = FANOUT):
        self.fanout = fanout
        self.slots = [f"slot_{k}" for k in range(fanout)]
        self.levels = [leaves]
        most = leaves.agg(F.max("size")).first()[0] or 0  # one number
        while most > 1:
            self.levels.append(written(self._parents(self.levels[-1]), f"level-{len(self.levels)}"))
            most = -(-most // fanout)

    def _above(self, place: Column) -> Column:
        return F.floor(place / self.fanout).cast("long")

    def _parents(self, nodes: DataFrame) -> DataFrame:
        slot = F.col("place") % self.fanout
        spread = [F.max(F.when(slot == k, F.col("hash"))).alias(s) for k, s in enumerate(self.slots)]
        rows = nodes.where("size > 1").groupBy("grp", self._above(F.col("place")).alias("place")).agg(F.max("size").alias("size"), *spread)
        return rows.select(
            "grp", "place", self._above(F.col("size") + (self.fanout - 1)).alias("size"),
            digest([F.coalesce(s, F.lit("")) for s in self.slots]).alias("hash"), *self.slots,
        )

    def tops(self) -> DataFrame:
        """(grp, hash) of the last node of each group."""
        tops = None
        for level in self.levels:
            last = level.where("size = 1").select("grp", "hash")
            tops = last if tops is None else tops.unionByName(last)
        return tops

    def paths(self, tops: DataFrame) -> DataFrame:
        """The leaves with ``steps``: the siblings left and right of each node on the way up, and what ``tops``
        (grp, steps, ...) has for the group, its steps coming last."""
        carried = [c for c in tops.columns if c not in ("grp", "steps")]
        down = None
        for k in reversed(range(len(self.levels))):
            nodes = self.levels[k].drop(*([] if k else self.slots))
            own = nodes.where("size = 1").join(tops, "grp") if down is not None else nodes.join(tops, "grp")
            if down is not None:
                slot = F.col("n.place") % self.fanout
                side = lambda other: F.concat(*[F.when(other(F.lit(j), slot), F.coalesce(f"p.{s}", F.lit(""))).otherwise("") for j, s in enumerate(self.slots)])
                step = F.struct(side(lambda j, s: j < s).alias("left"), side(lambda j, s: j > s).alias("right"))
                pair = (F.col("n.grp") == F.col("p.grp")) & (self._above(F.col("n.place")) == F.col("p.place"))
                below = nodes.where("size > 1").alias("n").join(down.alias("p"), pair)
                below = below.select("n.*", F.concat(F.array(step), F.col("p.steps")).alias("steps"), *[f"p.{c}" for c in carried])
                own = below.unionByName(own)
            down = own
        return down


class Manifest:
    """The manifest of a table; ``claimed`` gives, for some fields, another value whose leaf is to be verified.

    ``claims`` limits that to some rows; the others claim the leaf they have.  ``rows`` has a row per row of the table: id,
    leaf (hash), claimed leaf or null, subroot, root and steps.
    """

    def __init__(
        self,
        docs: DataFrame,
        fields: Sequence[str] = FIELDS,
        group: str = "source",
        order: str = "doc_id",
        claimed: Mapping[str, Column] | None = None,
        claims: Column | None = None,
        fanout: int = FANOUT,
    ):
        leaf = digest([field(F.col(c)) for c in fields])
        claim = F.lit(None).cast("string")
        if claimed:
            other = digest([field(claimed.get(c, F.col(c))) for c in fields])
            claim = other if claims is None else F.when(claims, other)
        slim = docs.select(
            F.col(order).alias("id"), group_of(F.col(group)).alias("grp"), leaf.alias("hash"), claim.alias("claim"),
            F.monotonically_increasing_id().alias("row"),
        )
        leaves = written(placed(written(slim, "leaves"), ["id", "hash", "row"]), "placed")
        self.order = order
        self.trees = Forest(leaves, fanout)
        sources = self.trees.tops().withColumnsRenamed({"grp": "name"}).withColumn("grp", F.lit(""))
        self.sources = Forest(written(placed(sources, ["name"]), "sources"), fanout)
        root = self.sources.tops().select("grp", F.col("hash").alias("root"), F.array().cast(STEPS).alias("steps"))
        named = self.sources.paths(root).select(F.col("name").alias("grp"), F.col("hash").alias("subroot"), "root", "steps")
        self.tops = written(named, "subroots")
        self.rows = self.trees.paths(self.tops)

    def subroots(self) -> DataFrame:
        """(source, subroot, root), a row per source."""
        name = F.when(F.col("grp") != "", F.expr("substring(grp, 2)"))
        return self.tops.select(name.alias("source"), "subroot", "root")

    def verified(self) -> DataFrame:
        """Every row's leaf, subroot, root, the hash of its siblings from the leaf up, the root that the claimed leaf and
        these siblings fold to, and whether that is the root."""
        siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
        fold = lambda node, s: digest([s["left"], node, s["right"]])
        folded = F.aggregate("steps", F.coalesce("claim", "hash"), fold)
        out = self.rows.select(
            F.col("id").alias(self.order), F.col("hash").alias("leaf"), "subroot", "root",
            F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"),
        )
        return out.withColumn("verified", F.col("folded_root") == F.col("root"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def audited(docs: DataFrame, every: int = 5) -> DataFrame:
    """The proof of every document, checked against a copy in which some texts have lost their capital letters: those
    whose CRC-32 of the decimal id is divisible by ``every``.  A null id is not tampered with."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % every == 0, F.lit(False))
    return Manifest(docs, claimed={"text": F.translate("text", UPPER, LOWER)}, claims=tampered).verified()

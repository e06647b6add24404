"""Tables that are kept: bucketed for joins without an exchange, appended to batch by batch, merged by newest row.

A batch is written to a folder of its own and becomes visible with one small row in a list of batches, which is written
last.  So a reader sees a batch whole or not at all, and a batch that is written again, after a failure or by mistake,
replaces itself.  One writer at a time is assumed.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrials.operators.ordered import newest


def bucketed(df: DataFrame, path: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """``df`` written to ``path`` in buckets of ``keys``, sorted by them, and read back.

    Joins and aggregations on all of ``keys`` between tables of as many buckets need no exchange.  The catalog knows the
    table only while it is made: the files stay, the entry goes.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018  (resolved while the entry is there)
    spark.sql(f"DROP TABLE {name}")
    return table


class _Listed:
    """The list of finished batches of a folder."""

    fields = ""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.data = spark, path.rstrip("/"), f"{path.rstrip('/')}/data"
        names = [f.split() for f in self.fields.split(", ")]
        none = spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in names])
        none.write.mode("ignore").parquet(f"{self.path}/batches")

    def _entries(self) -> DataFrame:
        return self.spark.read.schema(self.fields).parquet(f"{self.path}/batches")

    def _list(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/batches")  # a few rows


class BatchLog(_Listed):
    """Rows appended in batches, each at most once."""

    fields = "batch string"

    def append(self, rows: DataFrame, batch: str, partition: str = "target", salts: int = 4) -> None:
        """Write a batch; the same name again replaces it.  Its rows are dealt out as by
        :func:`codetrials.sources.writers.append_logs`."""
        self.write(rows, batch, partition, salts)
        if self._entries().where(F.col("batch") == batch).isEmpty():
            self._list(self.spark.range(1).select(F.lit(batch).alias("batch")))

    def write(self, rows: DataFrame, batch: str, partition: str = "target", salts: int = 4) -> None:
        """The first half of :meth:`append`: the rows, which nobody sees yet."""
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
        dealt = rows.repartition(F.col(partition), salt)
        dealt.write.mode("overwrite").partitionBy(partition).parquet(f"{self.data}/batch={batch}")

    def read(self, schema: str) -> DataFrame:
        """The rows of all finished batches, with the name of their ``batch``.  The list meets the folders by their
        partition column, so the folders of unfinished batches are not read."""
        rows = self.spark.read.schema(f"{schema}, batch string").parquet(self.data)
        return rows.join(self._entries().distinct(), "batch", "left_semi")


class NewestTable(_Listed):
    """The newest row of each key, kept up to date by merging batches.

    Keys are dealt over buckets by hash.  A merge reads and writes the buckets that the batch touches and no others; of
    each bucket the last finished merge counts.
    """

    fields = "batch string, version bigint, bucket int"

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str], buckets: int = 64):
        super().__init__(spark, path)
        self.keys, self.order, self.buckets = list(keys), list(order), buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _folders(self, but: str | None = None, of: Sequence[int] | None = None) -> list[str]:
        """The folder that counts for each bucket; at most one a bucket."""
        entries = self._entries() if but is None else self._entries().where(F.col("batch") != but)
        if of is not None:
            entries = entries.where(F.col("bucket").isin(list(of)))
        last = entries.groupBy("bucket").agg(F.max_by("batch", "version").alias("batch")).collect()
        return [f"{self.data}/batch={r.batch}/bucket={r.bucket}" for r in sorted(last)]

    def _rows(self, folders: list[str], schema) -> DataFrame:  # type: ignore[no-untyped-def]
        if folders:
            return self.spark.read.schema(schema).parquet(*folders)
        return self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])

    def read(self, schema) -> DataFrame:  # type: ignore[no-untyped-def]
        return self._rows(self._folders(), schema)

    def merge(self, rows: DataFrame, batch: str) -> list[int]:
        """Merge a batch, and return the buckets that were written.  The same name again merges into what was there
        before it, so its own rows are not there twice; batches must be merged again in their order, if at all."""
        latest = newest(rows, self.keys, self.order)
        touched = sorted(r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect())  # at most one a bucket
        old = self._rows(self._folders(but=batch, of=touched), rows.schema)
        merged = newest(old.unionByName(latest), self.keys, self.order).withColumn("bucket", self._bucket())
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.data}/batch={batch}")
        version = (self._entries().agg(F.max("version")).first()[0] or 0) + 1
        if touched:
            self._list(
                self.spark.range(1).select(
                    F.lit(batch).alias("batch"), F.lit(version).cast("bigint").alias("version"),
                    F.explode(F.array(*[F.lit(b) for b in touched])).alias("bucket"),
                )
            )
        return touched

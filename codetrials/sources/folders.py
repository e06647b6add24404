"""Source trees as a data source whose partitions are task folders.

The driver lists the names of the task folders, once and not below them, or takes them from a filter on ``task_id``, which
is pushed into the planning.  Each task of the job lists its own folders and reads their files, hidden names (``_x``, ``.x``)
included, which Spark's own file readers leave out.  The same source writes files under their own names.

Files are reached by pyarrow's file systems: local and shared folders, and the stores that pyarrow knows.  For a store
that only Spark's readers reach, use :func:`codetrials.sources.files.scan_impl_files`, which reports hidden names as rows
without content.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrials.sources.files import LAYOUTS, select_impls, select_tests

NAME = "task_folders"
SCHEMA = "task_id string, path string, content string, reject_reason string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FOLDERS = 64  # of one partition


def _source():  # type: ignore[no-untyped-def]
    """The data source.  Its classes are made here so that they travel to the workers by value, without this package."""
    import pyarrow as pa
    from pyspark.sql.datasource import (
        DataSource,
        DataSourceArrowWriter,
        DataSourceReader,
        EqualTo,
        In,
        InputPartition,
        WriterCommitMessage,
    )

    name, fields, per_partition = NAME, SCHEMA, FOLDERS
    batch_bytes = 4 << 20

    def store(root: str):  # type: ignore[no-untyped-def]
        import os

        from pyarrow import fs

        return fs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else os.path.abspath(root))

    class Folders(InputPartition):
        def __init__(self, names: list[str]):
            self.names = names

    class Reader(DataSourceReader):
        def __init__(self, options: dict[str, str]):
            self.root, self.base = options["root"], options.get("base", "")
            self.pattern, self.per = options["pattern"], int(options.get("folders", per_partition))
            self.names: list[str] | None = None

        def pushFilters(self, filters):  # type: ignore[no-untyped-def]
            for f in filters:
                known = None
                if isinstance(f, EqualTo) and f.attribute == ("task_id",):
                    known = {f.value}
                elif isinstance(f, In) and f.attribute == ("task_id",):
                    known = set(f.value)
                if known is None:
                    yield f
                else:
                    self.names = sorted(known if self.names is None else known & set(self.names))

        def partitions(self):  # type: ignore[no-untyped-def]
            from pyarrow import fs

            if self.names is None:
                where, root = store(self.root)
                top = fs.FileSelector(f"{root}/{self.base}".rstrip("/"), allow_not_found=True)
                names = sorted(i.base_name for i in where.get_file_info(top) if i.type == fs.FileType.Directory)
            else:
                names = [n for n in self.names if n not in ("", ".", "..") and "/" not in n]
            return [Folders(names[k : k + self.per]) for k in range(0, len(names), self.per)] or [Folders([])]

        def read(self, partition):  # type: ignore[no-untyped-def]
            import re

            from pyarrow import fs

            where, root = store(self.root)
            wanted = re.compile(self.pattern, re.S)
            schema = pa.schema([(c.split()[0], pa.string()) for c in fields.split(", ")])
            rows: list[tuple] = []
            held = 0
            for name_ in partition.names:
                folder = f"{root}/{self.base}{name_}"
                found = where.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
                for info in sorted((i for i in found if i.type == fs.FileType.File), key=lambda i: i.path):
                    path = info.path[len(root) + 1 :]
                    if not wanted.search(path):
                        continue
                    try:
                        with where.open_input_stream(info.path) as f:
                            rows.append((name_, path, f.read().decode("utf-8", "replace"), None))
                    except OSError as error:
                        rows.append((name_, path, None, f"cannot be read: {type(error).__name__}"))
                    held += info.size or 0
                    if held > batch_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    class Writer(DataSourceArrowWriter):
        def __init__(self, options: dict[str, str]):
            self.root = options["root"]

        def write(self, iterator):  # type: ignore[no-untyped-def]
            """Each file is written beside its place and then moved there, so a task that is run again harms nothing."""
            import uuid

            where, root = store(self.root)
            for batch in iterator:
                columns = batch.to_pydict()
                for path, content in zip(columns["path"], columns["content"], strict=True):
                    parts = (path or "").split("/")
                    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts):
                        raise ValueError(f"not a path below the root: {path!r}")
                    target = f"{root}/{path}"
                    where.create_dir(target.rpartition("/")[0], recursive=True)
                    with where.open_output_stream(beside := f"{target}.{uuid.uuid4().hex}.part") as f:
                        f.write((content or "").encode())
                    where.move(beside, target)
            return WriterCommitMessage()

    class TaskFolders(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return fields

        def reader(self, schema):  # type: ignore[no-untyped-def]
            return Reader(self.options)

        def writer(self, schema, overwrite):  # type: ignore[no-untyped-def]
            return Writer(self.options)

    return TaskFolders


def register(spark: SparkSession) -> None:
    """Make the source known to the session, and let filters reach it."""
    spark.dataSource.register(_source())
    spark.conf.set(PUSHDOWN, "true")


def _tasks(spark: SparkSession, root: str, pattern: str, base: str, task_ids: Sequence[str] | Column | None) -> DataFrame:
    register(spark)
    options = {"root": root, "base": base, "pattern": pattern.replace(r"\z", r"\Z"), "folders": str(FOLDERS)}
    found = spark.read.format(NAME).options(**options).load()
    if isinstance(task_ids, Column):
        return found.where(task_ids)
    return found if task_ids is None else found.where(F.col("task_id").isin(list(task_ids)))


def scan_impls(spark: SparkSession, root: str, layout: str, task_ids: Sequence[str] | Column | None = None) -> DataFrame:
    """``(task_id, impl, language, path, content, reject_reason)`` of the implementations below ``root``, hidden names with
    their content.  ``task_ids`` (ids, or a condition on ``task_id``) narrows the folders that are listed at all."""
    rule = LAYOUTS[layout]
    found = _tasks(spark, root, rule.code, _base(rule.code), task_ids)
    return select_impls(found.drop("task_id"), layout)


def scan_tests(spark: SparkSession, root: str, layout: str, task_ids: Sequence[str] | Column | None = None) -> DataFrame:
    """``(task_id, language, path, content, reject_reason)`` of the test suites."""
    rule = LAYOUTS[layout]
    return select_tests(_tasks(spark, root, rule.test, _base(rule.test), task_ids).drop("task_id"), layout)


def _base(pattern: str) -> str:
    """What stands before the task's folder."""
    return pattern.removeprefix(r"\A").partition("(")[0]


def write_files(files: DataFrame, root: str) -> None:
    """``(path, content)``: each row a file of that name below ``root``; a NULL content is an empty file."""
    register(files.sparkSession)
    files.select("path", "content").write.format(NAME).option("root", root).mode("append").save()

"""Readers of notebooks, task records and coverage reports."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codetrials.plans.scratch import scratch_path
from codetrials.schemas import JACOCO_COUNTERS, TASK_FIELDS

_NOTEBOOK = "notebook string, nbformat int, cells array<struct<cell_type: string, source: variant>>, _bad string"


def _joined_source(source: Column) -> Column:
    """A cell's text: stored as one string or as a list of strings."""
    listed = F.array_join(F.try_variant_get(source, "$", "array<string>"), "")
    return F.when(F.startswith(F.schema_of_variant(source), F.lit("ARRAY")), listed).otherwise(
        F.try_variant_get(source, "$", "string")
    )


def read_notebooks(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    """Notebooks as ``(notebook, cells ARRAY<STRUCT<pos, cell_type, source>>, reject_reason)``.

    ``path`` holds one ``.ipynb`` file per notebook, named by its path, or, with ``packed``, JSON lines with one
    notebook and its ``notebook`` name per line: the form to use for very many of them.  A missing path is an empty
    result; a file that is not a version 4 notebook has NULL cells and a reason.
    """
    reader = (
        spark.read.schema(_NOTEBOOK)
        .option("multiLine", not packed)
        .option("columnNameOfCorruptRecord", "_bad")
        .option("recursiveFileLookup", not packed)
    )
    if not packed:
        reader = reader.option("pathGlobFilter", "*.ipynb")
    try:
        raw = reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.range(0).select(F.from_json(F.lit("{}"), _NOTEBOOK).alias("n")).select("n.*")
        packed = True
    name = F.col("notebook") if packed else F.col("_metadata.file_path")
    return _checked(raw.select(name.alias("notebook"), "nbformat", "cells", "_bad"))


def _checked(raw: DataFrame) -> DataFrame:
    """``(notebook, cells, reject_reason)`` of parsed notebooks."""
    cells = F.transform(
        "cells",
        lambda c, i: F.struct(i.alias("pos"), c["cell_type"].alias("cell_type"), _joined_source(c["source"]).alias("source")),
    )
    good = (F.col("nbformat") == 4) & F.col("cells").isNotNull() & F.col("_bad").isNull()
    good = F.coalesce(good, F.lit(False))
    return raw.select(
        "notebook",
        F.when(good, cells).alias("cells"),
        F.when(~good, "not a version 4 notebook").alias("reject_reason"),
    )


def parse_notebooks(books: DataFrame, value: str = "value", name: str | None = None) -> DataFrame:
    """Notebooks held as JSON texts in a table, in the form of :func:`read_notebooks`, without a copy of them.

    The notebook's name is in the column ``name``, or in the JSON itself (``notebook``).
    """
    options = {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}
    book = F.from_json(F.col(value), _NOTEBOOK, options)
    named = F.col("_book.notebook") if name is None else F.col(name).cast("string")
    # as the output of a generator a book is parsed once
    parsed = books.select(*([] if name is None else [name]), F.explode(F.array(book)).alias("_book"))
    return _checked(parsed.select(named.alias("notebook"), "_book.nbformat", "_book.cells", "_book._bad"))


def notebook_cells(notebooks: DataFrame) -> DataFrame:
    """One row per cell: ``(notebook, pos, cell_type, source)``."""
    return notebooks.select("notebook", F.inline("cells"))


def read_tasks(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Task records: the eleven text fields, plus ``test_list`` for a ``test`` stored as a list of strings.

    A file holds one array of records or one record; with ``multi_line=False`` one record per line, the splittable
    form that :func:`codetrials.sources.writers.write_tasks` makes.
    """
    fields = ", ".join(f"{f} variant" if f == "test" else f"{f} string" for f in TASK_FIELDS)
    raw = spark.read.schema(fields).option("multiLine", multi_line).json(path)
    kind = F.schema_of_variant("test")
    return raw.withColumns(
        {
            "test_list": F.when(
                kind.isin("ARRAY<STRING>", "ARRAY<VOID>"), F.try_variant_get("test", "$", "array<string>")
            ),
            "test": F.when(kind == "STRING", F.try_variant_get("test", "$", "string")),
        }
    )


_JACOCO_NAMES = ["CLASS", "PACKAGE", *[c.upper() for c in JACOCO_COUNTERS]]


def read_jacoco(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """Coverage CSV: ``(report, class, package, <counters>, reject_reason)``.

    Reports are read line by line, so a large one is many tasks' work.  The columns of a report are taken by name from its
    own header, whatever their order and number; reports of one folder may differ.  The headers, first lines of the blocks
    at offset 0, are a table of a row per report, written to the shared folder so that its size is known to the join with
    the lines.  ``report`` is the file's path, or a partition column of the folder when ``run_id`` names one.

    A counter that is no integer, a line of another length than its header, or one with an open quote (a quoted line end
    cuts a record in two such lines) gives a reason.  Lines that repeat their header are not data.  A path without files
    is an empty table.
    """
    nothing = F.lit(None).cast("string")
    try:
        raw = spark.read.text(path)
        source = F.col(run_id).cast("string") if run_id else F.col("_metadata.file_path")
        lines = raw.select(
            source.alias("report"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("offset"),
            F.col("value").alias("line"),
        )
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        lines = spark.range(0).select(nothing.alias("report"), nothing.alias("file"), F.col("id").alias("offset"), nothing.alias("line"))
    headers = _headers(lines)
    rows = lines.where("line != ''").join(headers, "file").where(~((F.col("offset") == 0) & (F.col("line") == F.col("head"))))
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    # as the output of a generator a line is parsed once: a filter on what comes out of it would else be pushed below with a parse for each column
    parsed = F.struct(_csv_fields(F.col("line")).alias("fields"), (quotes % 2 == 0).alias("closed"))
    rows = rows.select("report", "places", "width", F.inline(F.array(parsed)))
    even = F.col("closed") & (F.size("fields") == F.col("width"))

    def named(name: str) -> Column:
        return F.when(even, F.get("fields", F.get("places", F.lit(_JACOCO_NAMES.index(name)))))

    counters = {c: named(c.upper()).try_cast("bigint") for c in JACOCO_COUNTERS}
    good = F.lit(True)
    for value in counters.values():
        good = good & value.isNotNull()
    return rows.select(
        "report",
        named("CLASS").alias("class"),
        named("PACKAGE").alias("package"),
        *[value.alias(name) for name, value in counters.items()],
        F.when(~F.col("closed"), "quote left open")
        .when(~even, "line and header differ in length")
        .when(~good, "counter is not an integer")
        .alias("reject_reason"),
    )


def _headers(lines: DataFrame) -> DataFrame:
    """``(file, head, width, places)``: the first line of each file, how many fields it has and where the known ones are.

    Of the lines that may be a header, those with a counter's name are groups of their own and the others of a file are
    one, so that a pass over all lines keeps a few groups a file and sorts nothing.  Files whose first line has no such name
    are read again for it.
    """
    spark = lines.sparkSession
    first = lines.where("offset = 0").select("file", "line", F.monotonically_increasing_id().alias("at"))
    kept = scratch_path(spark, "headers")
    _line_groups(first).groupBy("file").agg(F.min_by("line", "at").alias("head")).write.parquet(kept)
    found = spark.read.schema("file string, head string").parquet(kept)
    heads = found.where(F.col("head").isNotNull())
    unknown = found.where(F.col("head").isNull()).select("file")
    if not unknown.isEmpty():
        more = scratch_path(spark, "headers")
        first.join(unknown, "file", "left_semi").groupBy("file").agg(F.min_by("line", "at").alias("head")).write.parquet(more)
        heads = heads.unionByName(spark.read.schema("file string, head string").parquet(more))
    header = _csv_fields(F.col("head"))
    places = F.array(*[(F.array_position("header", F.lit(name)) - 1).cast("int") for name in _JACOCO_NAMES])
    return heads.select("file", "head", F.explode(F.array(header)).alias("header")).select(
        "file", "head", F.size("header").alias("width"), places.alias("places")
    )


def _line_groups(first: DataFrame) -> DataFrame:
    """``(file, line, at)``: first places of each line with a counter's name, and of all others of a file under no line."""
    likely = F.when(F.contains("line", F.lit(JACOCO_COUNTERS[0].upper())), F.col("line"))
    return first.groupBy("file", likely.alias("line")).agg(F.min("at").alias("at"))


def _csv_fields(line: Column) -> Column:
    """Fields of one line; a quoted one may hold commas and doubled quotes."""
    parts = F.regexp_extract_all(line, F.lit('(?:^|,)("(?:[^"]|"")*"|[^,"]*)'), F.lit(1))
    quoted = lambda f: F.replace(F.substr(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))
    read = F.transform(parts, lambda f: F.when(F.startswith(f, F.lit('"')), quoted(f)).otherwise(f))
    # without a quote the commas are the borders; a line that begins with one is read as it always was
    plain = ~F.contains(line, F.lit('"')) & ~F.startswith(line, F.lit(","))
    return F.when(plain, F.split(line, ",", -1)).otherwise(read)

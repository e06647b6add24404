"""Task fields out of annotation notebooks.

Only markdown cells count.  A cell ``### <field>`` arms that field; the next markdown cell that is neither such a
header nor a ``# Put...`` placeholder is its value, kept as written.  Dropping the placeholders first makes this a
one-row look-back: a cell is a value exactly if it is no header and the cell before it is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codetrials.functions.text import let, py_strip
from codetrials.operators.ordered import TEXT_BITS, lag_within
from codetrials.schemas import TASK_FIELDS

HEADER_MARK = "### "
PLACEHOLDER_MARK = "# Put"


def header_field(source: Column) -> Column:
    """Number (from 1) of the field a cell arms, NULL for any other cell."""
    name = py_strip(F.substring(source, len(HEADER_MARK) + 1, 2147483647))
    number = F.array_position(F.array(*[F.lit(f) for f in TASK_FIELDS]), name)
    return F.when(F.startswith(source, F.lit(HEADER_MARK)) & (number > 0), number.cast("int"))


def field_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(f) for f in TASK_FIELDS]), number)


def is_step(cell_type: Column, source: Column) -> Column:
    """Cells that can change the state: markdown without the placeholders."""
    return (cell_type == "markdown") & ~F.startswith(source, F.lit(PLACEHOLDER_MARK))


def extract_fields(cells: DataFrame, bits: int | None = TEXT_BITS) -> DataFrame:
    """``notebook_cells(notebook, pos, cell_type, source)`` -> ``(notebook, field, value, pos)``."""
    steps = cells.where(is_step(F.col("cell_type"), F.col("source"))).select(
        "notebook", "pos", "source", header_field(F.col("source")).alias("_arms")
    )
    return (
        lag_within(steps, ["notebook"], "pos", "_arms", "_armed", bits)
        .where(F.col("_arms").isNull() & F.col("_armed").isNotNull())
        .select("notebook", field_name(F.col("_armed")).alias("field"), F.col("source").alias("value"), "pos")
    )


def _values(cells: Column) -> Column:
    """The filled fields of one notebook as ``ARRAY<STRUCT<field INT, value, pos, arms INT>>``, in cell order."""

    def pairs(steps: Column) -> Column:
        looked_back = F.transform(
            steps,
            lambda cell, i: F.struct(
                F.get(steps, i - 1)["arms"].alias("field"),
                cell["source"].alias("value"),
                cell["pos"].alias("pos"),
                cell["arms"].alias("arms"),
            ),
        )
        return F.filter(looked_back, lambda p: p["arms"].isNull() & p["field"].isNotNull())

    steps = F.transform(
        F.filter(cells, lambda c: is_step(c["cell_type"], c["source"])),
        lambda c: F.struct(c["pos"], c["source"], header_field(c["source"]).alias("arms")),
    )
    return let(steps, pairs)


def extract_fields_nested(notebooks: DataFrame) -> DataFrame:
    """The same for whole notebooks, ``(notebook, cells ARRAY<STRUCT<pos, cell_type, source>>)``: one row holds all
    its cells, so nothing is shuffled."""
    return notebooks.select("notebook", F.explode(_values(F.col("cells"))).alias("v")).select(
        "notebook", field_name(F.col("v.field")).alias("field"), "v.value", "v.pos"
    )


def records_nested(notebooks: DataFrame) -> DataFrame:
    """One record per whole notebook that has any filled field, also without a shuffle."""

    def last_value(values: Column, number: int) -> Column:
        return F.try_element_at(F.filter(values, lambda v: v["field"] == number), F.lit(-1))["value"]

    def record(values: Column) -> Column:
        last = [last_value(values, number).alias(name) for number, name in enumerate(TASK_FIELDS, 1)]
        return F.when(F.size(values) > 0, F.struct(*last))

    filled = F.array_compact(F.array(let(_values(F.col("cells")), record)))
    return notebooks.select("notebook", F.inline(filled))


def pivot_fields(fields: DataFrame) -> DataFrame:
    """``(notebook, field, value, pos)`` -> one record per notebook; a repeated field keeps its last value.

    The field list is fixed, so there is no job to find it, and every task combines its rows before the shuffle.
    """
    return fields.groupBy("notebook").agg(
        *[
            F.max_by(F.when(F.col("field") == name, F.col("value")), F.when(F.col("field") == name, F.col("pos"))).alias(name)
            for name in TASK_FIELDS
        ]
    )

from __future__ import annotations

import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from codetrials.operators import notebooks
from codetrials.schemas import NOTEBOOK_CELLS, TASK_FIELDS

MD, CODE = "markdown", "code"

GOLDEN = [
    ([(MD, "### task_id"), (MD, "# Put id"), (MD, "t1")], [("task_id", "t1")]),
    ([(MD, "### prompt "), (CODE, "x=1"), (MD, "def f():")], [("prompt", "def f():")]),
    ([(MD, "### test"), (MD, "### language"), (MD, "Python")], [("language", "Python")]),
    ([(MD, "### prompt"), (MD, "### Notes")], [("prompt", "### Notes")]),
    ([(MD, "### prompt"), (MD, "")], [("prompt", "")]),
    ([(MD, "### prompt"), (MD, "a"), (MD, "b")], [("prompt", "a")]),
    ([(MD, "###  prompt\n\x1c"), (MD, "  kept  ")], [("prompt", "  kept  ")]),
    ([(CODE, "### prompt"), (MD, "x")], []),
    ([(MD, "##### prompt"), (MD, "x")], []),
]


def cells_frame(spark, books):
    data = [(f"n{i}", pos, kind, text) for i, book in enumerate(books) for pos, (kind, text) in enumerate(book)]
    return spark.createDataFrame(data, NOTEBOOK_CELLS)


def state_machine(book):
    """The rule told cell by cell."""
    armed, out = None, []
    for pos, (kind, text) in enumerate(book):
        if kind != MD:
            continue
        name = text[4:].strip()
        if text.startswith("### ") and name in TASK_FIELDS:
            armed = name
        elif armed is not None and not text.startswith("# Put"):
            out.append((armed, text, pos))
            armed = None
    return out


@pytest.mark.parametrize("case", range(len(GOLDEN)))
def test_golden(spark, case):
    book, want = GOLDEN[case]
    got = notebooks.extract_fields(cells_frame(spark, [book])).select("field", "value")
    assert rows(got) == sorted(want)


def random_books(n, longest, seed):
    rng = random.Random(seed)
    texts = ["### prompt", "### test ", "### Notes", "# Put here", "# Putter", "", "value", "### language", " ### test"]
    return [
        [(rng.choice([MD, MD, MD, CODE]), rng.choice(texts)) for _ in range(rng.randint(0, longest))]
        for _ in range(n)
    ]


@pytest.mark.parametrize("bits", [0, 1, 3, 17, None])
def test_runs_agree_with_the_state_machine(spark, bits):
    """Short runs force the carry-over between runs, which may also be empty."""
    books = random_books(60, 40, seed=bits or 0)
    want = sorted(
        (f"n{i}", field, value, pos) for i, book in enumerate(books) for field, value, pos in state_machine(book)
    )
    assert sorted(tuple(r) for r in notebooks.extract_fields(cells_frame(spark, books), bits).collect()) == want


def test_nested_form_agrees(spark):
    books = random_books(80, 30, seed=99)
    data = [
        (f"n{i}", [(pos, kind, text) for pos, (kind, text) in enumerate(book)]) for i, book in enumerate(books)
    ]
    nested = spark.createDataFrame(
        data, "notebook string, cells array<struct<pos: int, cell_type: string, source: string>>"
    )
    want = sorted(
        (f"n{i}", field, value, pos) for i, book in enumerate(books) for field, value, pos in state_machine(book)
    )
    got = notebooks.extract_fields_nested(nested)
    assert sorted(tuple(r) for r in got.collect()) == want
    assert "Exchange" not in plan(got)
    records = notebooks.records_nested(nested)
    assert "Exchange" not in plan(records)
    assert rows(records) == rows(notebooks.pivot_fields(notebooks.extract_fields_nested(nested)))


def test_repeated_field_keeps_last(spark):
    book = [(MD, "### prompt"), (MD, "first"), (MD, "### prompt"), (MD, "second"), (MD, "### test"), (MD, "t")]
    record = notebooks.pivot_fields(notebooks.extract_fields(cells_frame(spark, [book]))).first()
    assert (record.prompt, record.test, record.language) == ("second", "t", None)
    assert record.__fields__ == ["notebook", *TASK_FIELDS]


def test_hot_notebook_is_split(spark):
    """The rows of one notebook are shuffled by run, so they spread over many partitions."""
    cells = spark.range(4000).select(
        F.when(F.col("id") >= 0, "hot").alias("notebook"),
        F.col("id").cast("int").alias("pos"),
        F.lit(MD).alias("cell_type"),
        F.when(F.col("id") % 2 == 0, "### prompt").otherwise("v").alias("source"),
    )
    found = notebooks.extract_fields(cells, bits=6)
    text = plan(found)
    assert "hashpartitioning(notebook" in text and "_run" in text
    assert found.count() == 2000

"""Hard negatives by slots: for each anchor and each of its positives, the best rows of other labels in a window of scores
that hangs from the positive's own score.

The windows of an anchor's positives overlap.  Their upper limits split the scores into disjoint slots, so each row falls
into one slot of an anchor, and the best ``k`` of a slot are kept by combiners: in the scoring task, before the shuffle,
and once more per anchor.  A window is a suffix of the slots, cut off at its lower limit; the best ``k`` of it are the first
``k`` of its slots' lists laid end to end, so one descending list per anchor, of at most ``k`` rows a slot, answers all its
windows.

Vectors are written once as blocks of whole numbers.  Anchors and rows meet in cells, dealt by hash and not by label: an
anchor group times a row group, both of bounded size, scored by one matrix product; a cell gives one row with the lists
of its anchors.  Scoring every row against every anchor is what is asked for; work is rows times anchors, and what is sent
is one copy of a row for each group of anchors and one of an anchor for each group of rows.

Defined cases: rows with a null label, vector, component, or id, or with a component that is not finite, take no part.
Repeated rows are rows of their own; an anchor that stands twice has its results twice, and its copy is a positive of it.
Vectors of different length are compared on the shorter one's.  A component beyond 62 bits or a score beyond 56 raises.  An empty table
gives no rows.  Columns other than id, label and vector are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codetrials.plans.scratch import scratch_path

BLOCK_ROWS = 4096
GROUP_ROWS = 16384  # rows of a cell, on average
GROUP_ANCHORS = 1024  # anchors of a cell, on average
POSITIVES, NEGATIVES = 5, 10
SCALE = 256
LOWER, UPPER = 30, 90  # per cent of the positive's score
BLOCKS = "block long, rows long, anchors long, width long, ids binary, labels binary, vectors binary"
GROUPS = "grp long, block long, width long, tags binary, ids binary, labels binary, vectors binary"
POSITIVE = ("grp", "block", "anchor", "anchor_id", "id", "score")  # of a cell's list; the last two are ranked
NEGATIVE = ("anchor", "slot", "id", "score")
EXACT, MOST = 1 << 53, 1 << 56  # scores below are exact in doubles; hundredfold in 64 bits


def whole_numbers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) as 64-bit integers."""
    scaled = np.floor(vectors.astype(np.float64) * SCALE)
    if scaled.size and np.abs(scaled).max() >= 2.0**62:
        raise ValueError("a component is beyond 62 bits")
    return scaled.astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two integer matrices, exact."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * width
    if most < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    if max(abs(x) for x in exact.flat) >= MOST:
        raise ValueError("a score is beyond 56 bits")
    return exact.astype(np.int64)


def in_blocks(rows: DataFrame, anchors_every: int) -> DataFrame:
    """(id long, label long, vector array<double>) in blocks of ``BLOCK_ROWS`` rows of one width, in the order of their ids."""

    def block(number: int, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        small = np.int16 if np.abs(vectors).max(initial=0) < 1 << 15 else np.int64
        row = {
            "block": number, "rows": len(ids), "anchors": int((ids % anchors_every == 0).sum()),
            "width": vectors.shape[1] * (1 if small is np.int16 else -1),
            "ids": ids[order].tobytes(), "labels": labels[order].tobytes(), "vectors": vectors[order].astype(small).tobytes(),
        }
        return pa.RecordBatch.from_pylist([row])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 31
        for batch in batches:
            lists = batch.column(2)
            ids, labels = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            begins = np.cumsum(sizes) - sizes
            for width in np.unique(sizes):
                at = np.flatnonzero(sizes == width)
                for k in range(0, len(at), BLOCK_ROWS):
                    some = at[k : k + BLOCK_ROWS]
                    vectors = whole_numbers(flat[begins[some, None] + np.arange(width)])
                    yield block(number, ids[some], labels[some], vectors)
                    number += 1

    path = scratch_path(rows.sparkSession, "vectors")
    rows.mapInArrow(run, BLOCKS).write.parquet(path)
    return rows.sparkSession.read.schema(BLOCKS).parquet(path)


class Block:
    """Vectors of one width; a tag is a row's number, the same in every pass."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.labels = np.frombuffer(row["labels"], dtype=np.int64)
        kind = np.int16 if row["width"] >= 0 else np.int64
        self.vectors = np.frombuffer(row["vectors"], dtype=kind).reshape(len(self.ids), abs(row["width"])).astype(np.int64)
        tags = row.get("tags")
        self.tags = np.frombuffer(tags, dtype=np.int64) if tags else row["block"] * BLOCK_ROWS + np.arange(len(self.ids))
        self.blocks = np.full(len(self.ids), row["block"])

    def slices(self, size: int) -> Iterator[Block]:
        for k in range(0, len(self.ids), size):
            part = object.__new__(Block)
            part.__dict__.update({name: x[k : k + size] for name, x in self.__dict__.items()})
            yield part


def by_width(rows: list[dict]) -> list[Block]:
    """Blocks laid together, one of each width."""
    found: dict[int, list[Block]] = {}
    for b in map(Block, rows):
        found.setdefault(b.vectors.shape[1], []).append(b)
    for some in found.values():
        some[0].__dict__.update({name: np.concatenate([b.__dict__[name] for b in some]) for name in some[0].__dict__})
    return [some[0] for some in found.values()]


def anchors_of(blocks: DataFrame, every: int, groups: int) -> DataFrame:
    """The anchors of each block, dealt over ``groups`` groups, as small blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                at = np.flatnonzero(b.ids % every == 0)
                dealt = (b.tags[at] * 0x9E3779B1 >> 12) % groups
                kind = np.int16 if row["width"] >= 0 else np.int64
                for g in np.unique(dealt):
                    own = at[dealt == g]
                    part = {"tags": b.tags[own], "ids": b.ids[own], "labels": b.labels[own], "vectors": b.vectors[own].astype(kind)}
                    part = {name: x.tobytes() for name, x in part.items()}
                    out = {"grp": int(g), "block": row["block"], "width": row["width"], **part}
                    yield pa.RecordBatch.from_pylist([out])

    return blocks.where("anchors > 0").mapInArrow(run, GROUPS)


def best(scores: np.ndarray, at: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at`` the ``k`` with the highest scores, ties by smaller id."""
    if len(at) > k:
        own = scores[at]
        at = at[own >= np.partition(own, len(at) - k)[len(at) - k]]
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def combined(rows: np.ndarray, k: int) -> np.ndarray:
    """The best ``k`` columns of each key; the last two of a column are id and score, the rest is its key."""
    rows = rows[:, np.lexsort((rows[-2], -rows[-1], *rows[-3::-1]))]
    new = np.ones(rows.shape[1], dtype=bool)
    new[1:] = (rows[:-2, 1:] != rows[:-2, :-1]).any(axis=0)
    begin = np.flatnonzero(new)
    rank = np.arange(rows.shape[1]) - np.repeat(begin, np.diff([*begin, rows.shape[1]]))
    return rows[:, rank < k]


def positives_in(k: int) -> Callable:
    """Of each anchor the best ``k`` other rows of its label."""

    def score(anchors: Block, rows: Block, scores: np.ndarray, limits: dict) -> Iterator[tuple]:
        for n, own in enumerate(scores):
            at = best(own, np.flatnonzero((rows.labels == anchors.labels[n]) & (rows.tags != anchors.tags[n])), rows.ids, k)
            yield limits["grp"], anchors.blocks[n], anchors.tags[n], anchors.ids[n], rows.ids[at], own[at]

    return score


def negatives_in(k: int, lower: int, upper: int) -> Callable:
    """Of each anchor and slot the best ``k`` rows of other labels.

    Slot j holds the scores above the upper limit of positive j + 1 and up to that of positive j; of them only those at or
    above the lower limit of positive j are of use.  A positive of negative score has an empty window, and no slot.
    """

    def score(anchors: Block, rows: Block, scores: np.ndarray, limits: dict) -> Iterator[tuple]:
        for n, own in enumerate(scores):
            of = limits["scores"].get(int(anchors.tags[n]))
            if of is None:
                continue
            top, low = of * upper // 100, -(-of * lower // 100)
            at = np.flatnonzero((own <= top[0]) & (own >= low[-1]) & (rows.labels != anchors.labels[n]))
            slot = len(top) - np.searchsorted(top[::-1], own[at])  # from 1: the number of limits at or above the score
            for j in np.unique(slot):
                inside = at[slot == j]
                inside = best(own, inside[own[inside] >= low[j - 1]], rows.ids, k)
                yield anchors.tags[n], j, rows.ids[inside], own[inside]

    return score


def in_cells(anchors: DataFrame, blocks: DataFrame, shape: tuple[int, int], score: Callable, columns: Sequence[str], k: int) -> DataFrame:
    """Every group of anchors with every group of rows; the best ``k`` of each key of ``columns`` by cell, then by task."""
    numbers = lambda n: F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))
    left = anchors.withColumn("part", F.explode(numbers(shape[1])))
    right = blocks.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(shape[1]))).withColumn("grp", F.explode(numbers(shape[0])))

    def cell(a: pa.Table, b: pa.Table) -> pa.Table:
        lists = [np.empty((len(columns), 0), dtype=np.int64)]
        if a.num_rows and b.num_rows:
            limits = {"grp": a.column("grp")[0].as_py(), "scores": {}}
            if "limits" in a.column_names:
                for one in (x for some in a.column("limits").to_pylist() for x in some or ()):
                    limits["scores"][one["anchor"]] = np.array(one["scores"], dtype=np.int64)
            rows = by_width(b.select(["block", "width", "ids", "labels", "vectors"]).to_pylist())
            for some in (s for w in by_width(a.select(["block", "width", "tags", "ids", "labels", "vectors"]).to_pylist()) for s in w.slices(GROUP_ANCHORS)):
                for other in (s for w in rows for s in w.slices(BLOCK_ROWS)):
                    for found in score(some, other, products(some.vectors, other.vectors), limits):
                        if len(found[-1]):
                            lists.append(np.stack([np.broadcast_to(x, found[-1].shape) for x in found]))
        whole = combined(np.concatenate(lists, axis=1), k)
        return pa.table({"found": pa.array([whole.tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((len(columns), 0), dtype=np.int64)
        for batch in batches:
            for value in batch.column(0):
                held = np.concatenate([held, np.frombuffer(value.as_py(), dtype=np.int64).reshape(len(columns), -1)], axis=1)
                if held.shape[1] > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in combined(held, k)], names=list(columns))
                    held = held[:, :0]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in combined(held, k)], names=list(columns))

    met = left.groupBy("grp", "part").cogroup(right.groupBy("grp", "part")).applyInArrow(cell, "found binary")
    return met.mapInArrow(run, ", ".join(f"{c} long" for c in columns))


HELD = 1 << 21  # columns that a task combines at once


def ranked(rows: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The best ``k`` rows of each key with ``rank``, from 1; a group limit before the shuffle keeps ``k`` of a task."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mine(
    rows: DataFrame,
    key: str = "vec_id",
    label: Column | str = "label",
    vector: str = "embedding",
    every: int = 100,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lower: int = LOWER,
    upper: int = UPPER,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose id is divisible by ``every``; an anchor's positives are its best ``positives`` other rows of
    the same label; of each, the best ``negatives`` rows of other labels whose score is from ``lower`` to ``upper`` per cent of
    the positive's.  A score is the inner product of the vectors' components, each floor(256 x).
    """
    label = F.col(label) if isinstance(label, str) else label
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    known = F.col(key).isNotNull() & label.isNotNull() & F.col(vector).isNotNull()
    slim = rows.where(known & finite).select(
        F.col(key).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("vector")
    )
    blocks = in_blocks(slim, every)
    n_rows, n_anchors = blocks.agg(F.sum("rows"), F.sum("anchors")).first()  # two numbers
    shape = max(1, -(-(n_anchors or 0) // GROUP_ANCHORS)), max(1, -(-(n_rows or 0) // GROUP_ROWS))
    anchors = written(anchors_of(blocks, every, shape[0]), "anchors")
    near = in_cells(anchors, blocks, shape, positives_in(positives), POSITIVE, positives)
    near = written(ranked(near, ["anchor"], positives), "positives")
    scores = F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"])
    of_anchor = near.where("score >= 0").groupBy("grp", "block", "anchor").agg(scores.alias("scores"))
    limits = of_anchor.groupBy("grp", "block").agg(F.collect_list(F.struct("anchor", "scores")).alias("limits"))
    far = in_cells(anchors.join(limits, ["grp", "block"]), blocks, shape, negatives_in(negatives, lower, upper), NEGATIVE, negatives)
    in_slots = ranked(far, ["anchor", "slot"], negatives)
    descending = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("under"), "id", "slot")))
    lists = in_slots.groupBy("anchor").agg(descending.alias("list"))
    suffix = F.filter("list", lambda x: (x["slot"] >= F.col("rank")) & (x["under"] * -100 >= F.col("score") * lower))
    return (
        near.where("score >= 0")
        .join(lists, "anchor")
        .select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), F.posexplode(F.slice(suffix, 1, negatives)).alias("at", "found"))
        .select(
            "anchor_id", "positive_id", (F.col("at") + 1).alias("rank"), F.col("found.id").alias("negative_id"),
            "positive_score", (-F.col("found.under")).alias("negative_score"),
        )
    )

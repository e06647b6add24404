"""Texts in blocks, and questions between blocks and buckets of hashes.

A per-word or per-byte method makes too many values for one row each.  Here a corpus is written once, as one row per
block of a few megabytes of text, to the shared folder; since the block number is stored with it, every later pass names
the same rows by it.  A pass over the blocks emits, for each bucket of hash values, one row with a sorted array of the
block's distinct values.  A bucket, grouped by Spark, answers each block that asked (``answered``), and the answers meet
their blocks in a cogroup (``told``).  A value that a third of all texts share is one entry per block, so no bucket is
larger than its share of distinct values times the blocks.

The blocks are a table bucketed by ``home`` (a few consecutive blocks), so the cogroups move the answers and not the
texts.  A lost executor costs the tasks it held; all that is read again lies in the shared folder.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrials.plans.scratch import scratch_path

BLOCK_BYTES = 4 << 20
NO_ID = np.iinfo(np.int64).max  # a row without an id comes after all others
BLOCKS = "home long, block long, ids binary, lens binary, digests binary, body binary"
ASKED = "bucket long, block long, payload binary"
ANSWERED = "home long, block long, bucket long, payload binary"
HOME_BITS = 2  # four blocks have one home
DIGEST = 16  # bytes
BLOCK_BITS, ROW_BITS = 13, 19  # blocks of a task, rows of a block: with 31 bits for the task, a row's number has 63


@dataclass
class Block:
    """``data`` holds the texts one after the other, each followed by one line feed; ``begins`` and ``ends`` delimit
    them in it."""

    number: int
    ids: np.ndarray
    lens: np.ndarray  # -1: null
    digests: np.ndarray  # of the texts
    data: np.ndarray

    @property
    def begins(self) -> np.ndarray:
        size = np.maximum(self.lens, 0) + 1
        return np.cumsum(size) - size

    @property
    def ends(self) -> np.ndarray:
        return self.begins + np.maximum(self.lens, 0)

    def raw(self) -> bytes:
        return self.data.tobytes()


def _row(number: int, ids: list, texts: list) -> dict:
    body = b"".join((t or b"") + b"\n" for t in texts)
    return {
        "home": number >> HOME_BITS,
        "block": number,
        "ids": np.array([NO_ID if i is None else i for i in ids], dtype=np.int64).tobytes(),
        "lens": np.array([-1 if t is None else len(t) for t in texts], dtype=np.int64).tobytes(),
        "digests": b"".join(hashlib.sha256(t or b"").digest()[:DIGEST] for t in texts),
        "body": zstandard.ZstdCompressor(level=3).compress(body),
    }


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = BLOCK_BYTES) -> DataFrame:
    """Write the texts in blocks of about ``size`` bytes (a longer text is a block of its own) and read them back.

    The table is bucketed into ``spark.sql.shuffle.partitions`` parts, the tasks of every later pass over the blocks: the
    setting must grow with the corpus.  The catalog knows the table only while it is made; the files stay.
    """
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = number = TaskContext.get().partitionId() << BLOCK_BITS
        ids: list = []
        texts: list = []
        held = 0

        def flush():
            nonlocal number, ids, texts, held
            if number >> BLOCK_BITS != first >> BLOCK_BITS:
                raise ValueError(f"a task has more than {1 << BLOCK_BITS} blocks: read the table in smaller partitions")
            out = pa.RecordBatch.from_pylist([_row(number, ids, texts)])
            number, ids, texts, held = number + 1, [], [], 0
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                t = t.as_py()
                if ids and (held + len(t or b"") > size or len(ids) >> ROW_BITS):
                    yield flush()
                ids.append(i)
                texts.append(t)
                held += len(t or b"") + 1
        if ids:
            yield flush()

    name = f"blocks_{uuid.uuid4().hex}"
    (
        as_bytes(docs, key, text)
        .mapInArrow(run, BLOCKS)
        .write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), "home")
        .option("compression", "uncompressed")
        .option("path", scratch_path(spark, "blocks"))
        .saveAsTable(name)
    )
    table = spark.table(name)
    table.schema  # noqa: B018  (resolved while the entry is there)
    spark.sql(f"DROP TABLE {name}")
    return table


def in_chunks(batches: Iterator[pa.RecordBatch], size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows (id long, text binary) of Arrow batches as blocks of about ``size`` bytes that are stored nowhere."""
    ids: list = []
    texts: list = []
    held = 0

    def block():
        return Block(
            0,
            np.array([NO_ID if i is None else i for i in ids], dtype=np.int64),
            np.array([-1 if t is None else len(t) for t in texts], dtype=np.int64),
            np.empty((0, 2), dtype=np.uint64),
            np.frombuffer(b"".join((t or b"") + b"\n" for t in texts), dtype=np.uint8),
        )

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            t = t.as_py()
            if ids and held + len(t or b"") > size:
                yield block()
                ids, texts, held = [], [], 0
            ids.append(i)
            texts.append(t)
            held += len(t or b"") + 1
    if ids:
        yield block()


def as_bytes(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(id, text as bytes); ids are whole numbers, and others raise here rather than in a task."""
    kind = docs.schema[key].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"column {key!r} holds {kind} and no whole numbers")
    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").cast("binary").alias("t"))


def real_id(i: int) -> int | None:
    return None if i == NO_ID else i


def bucket_count(blocks: DataFrame, share: int = 4) -> int:
    """A bucket for every ``share`` blocks: as much as one pass over a block makes, times ``share``, meets in a task."""
    return max(1, blocks.select("block").count() // share)


def blocks_of(table: pa.Table | pa.RecordBatch) -> Iterator[Block]:
    names = {n: i for i, n in enumerate(table.schema.names)}
    for k in range(table.num_rows):
        at = {n: table.column(names[n])[k].as_py() for n in ("block", "ids", "lens", "digests", "body")}
        body = zstandard.ZstdDecompressor().decompress(at["body"])
        yield Block(
            at["block"],
            np.frombuffer(at["ids"], dtype=np.int64),
            np.frombuffer(at["lens"], dtype=np.int64),
            np.frombuffer(at["digests"], dtype="<u8").reshape(-1, 2),
            np.frombuffer(body, dtype=np.uint8),
        )


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MARKS = np.zeros(256, dtype=bool)  # what stands between lower-cased words: ASCII but for letters and digits
MARKS[:0x30] = MARKS[0x3A:0x61] = MARKS[0x7B:0x80] = True


def each_block(blocks: DataFrame, act: Callable[[Block], Iterable[tuple]], schema: str = ASKED) -> DataFrame:
    """Rows of ``schema`` that ``act`` makes of each block."""

    def run(batches):
        for batch in batches:
            for block in blocks_of(batch):
                yield from packed(list(act(block)), schema)

    return blocks.mapInArrow(run, schema)


def answered(
    questions: DataFrame, answer: Callable[[list[tuple[int, bytes]]], Iterable[tuple[int, bytes]]]
) -> DataFrame:
    """``answer`` sees the (block, payload) rows of one bucket and gives (block, payload) rows."""

    def run(key, table):
        rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True))
        out = [(k >> HOME_BITS, k, key[0].as_py(), p) for k, p in answer(rows)]
        return pa.Table.from_batches(list(packed(out, ANSWERED)), arrow_schema(ANSWERED))

    return questions.groupBy("bucket").applyInArrow(run, ANSWERED)


def told(
    blocks: DataFrame,
    answers: DataFrame,
    act: Callable[[Block, dict[int, list[bytes]]], Iterable[tuple]],
    schema: str = ASKED,
) -> DataFrame:
    """``act`` sees each block with the payloads of all answers to it, by bucket, and gives rows of ``schema``."""

    def run(left, right):
        mine: dict = defaultdict(lambda: defaultdict(list))
        for k, b, p in zip(*(right.column(n).to_pylist() for n in ("block", "bucket", "payload")), strict=True):
            mine[k][b].append(p)
        out = []
        for block in blocks_of(left):
            out += packed(list(act(block, mine[block.number])), schema)
        return pa.Table.from_batches(out, arrow_schema(schema))

    return blocks.groupBy("home").cogroup(answers.groupBy("home")).applyInArrow(run, schema)


COPIES = -1  # the bucket of the answers that first_copies() gives
DIGESTS = 1 << 20  # of one bucket, 40 bytes each
DIGESTED = np.dtype([("high", "<u8"), ("low", "<u8"), ("id", "<i8"), ("row", "<i8"), ("rows", "<i8")])


def first_copies(blocks: DataFrame) -> DataFrame:
    """Answers that tell each block, for the digests of its texts, the smallest id that has the text and in how many rows
    the text stands.  Only digests travel, each once for a block.
    """
    rows_there = blocks.agg(F.sum(F.octet_length("ids") / 8)).first()[0] or 0  # one number
    buckets = max(1, -(-int(rows_there) // DIGESTS))

    def ask(batches):
        for batch in batches:
            for k, ids, digests in zip(*(batch.column(n).to_pylist() for n in range(3)), strict=True):
                rows = np.empty(len(ids) // 8, dtype=DIGESTED)
                both = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
                rows["high"], rows["low"], rows["id"] = both[:, 0], both[:, 1], np.frombuffer(ids, dtype=np.int64)
                rows["row"], rows["rows"] = (k << ROW_BITS) + np.arange(len(rows)), 1
                rows = smallest(rows)
                parts = by_bucket(rows["high"], buckets)
                yield from packed([(b, k, rows[at].tobytes()) for b, at in parts], ASKED)

    def answer(parts):
        every = [np.frombuffer(p, dtype=DIGESTED) for _, p in parts]
        least = smallest(np.concatenate(every))
        for (k, _), rows in zip(parts, every, strict=True):
            at = np.searchsorted(least["high"], rows["high"])
            same = least["low"][at] == rows["low"]  # else two digests of one first half, which are left apart
            yield k, least[at[same]].tobytes()

    asked = blocks.select("block", "ids", "digests").mapInArrow(ask, ASKED)
    return answered(asked, answer).withColumn("bucket", F.lit(COPIES).cast("long"))


def smallest(rows: np.ndarray) -> np.ndarray:
    """For each digest: its smallest id, the first row of that id, and the sum of its rows."""
    rows = rows[np.lexsort((rows["row"], rows["id"], rows["low"], rows["high"]))]
    differs = (rows["high"][1:] != rows["high"][:-1]) | (rows["low"][1:] != rows["low"][:-1])
    first = np.flatnonzero(np.append(True, differs)[: len(rows)])
    out = rows[first].copy()
    if len(rows):
        out["rows"] = np.add.reduceat(rows["rows"], first)
    return out


def copies_of(block: Block, answers: dict[int, list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text of a block: does a row with a smaller id have it, and does any other row?"""
    mine = _first(block, answers)
    return np.array([f < i for f, _, _, i, _ in mine], dtype=bool), np.array([n > 1 for _, _, n, _, _ in mine], dtype=bool)


def later_rows(block: Block, answers: dict[int, list[bytes]]) -> np.ndarray:
    """Which rows have a text that a row with a smaller id, or an earlier row with that id, has too."""
    return np.array([(f, r) < (i, row) for f, r, _, i, row in _first(block, answers)], dtype=bool)


def _first(block, answers):
    least = np.concatenate([np.empty(0, dtype=DIGESTED), *(np.frombuffer(p, dtype=DIGESTED) for p in answers[COPIES])])
    first = {(h, low): (i, r, n) for h, low, i, r, n in least.tolist()}
    rows = range(block.number << ROW_BITS, (block.number << ROW_BITS) + len(block.ids))
    keys = zip(block.digests.tolist(), block.ids.tolist(), rows, strict=True)
    return [(*first[h, low], i, row) for (h, low), i, row in keys]


# --- which of a block's hashes another block has too ---------------------------------------------------------------


def distinct_by_bucket(values: np.ndarray, owner: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, the block's distinct values in it, their 31-bit remainders with a flag for values of two owners)."""
    if not len(values):
        return []
    order = np.argsort(values, kind="stable")
    edge = edges(values[order])
    several = np.minimum.reduceat(owner[order], edge) != np.maximum.reduceat(owner[order], edge)
    distinct = values[order][edge]
    brief = ((distinct * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(33)).astype(np.uint32) << np.uint32(1)
    return [(b, distinct[at], brief[at] | several[at]) for b, at in by_bucket(distinct, buckets)]


def shared(rows: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Answer each block, for each of its values in a bucket, whether two owners have it: a bit a value, in order."""
    parts = [np.frombuffer(p, dtype=np.uint32) for _, p in rows]
    every = np.concatenate(parts)
    names, several = every >> np.uint32(1), (every & np.uint32(1)).astype(bool)
    order = np.argsort(names, kind="stable")
    edge = edges(names[order])
    count = np.diff(np.append(edge, len(order)))
    many = np.logical_or.reduceat(several[order], edge) | (count > 1)
    answer = np.empty(len(names), dtype=bool)
    answer[order] = np.repeat(many, count)
    for (k, _), bits in zip(rows, np.split(answer, np.cumsum([len(x) for x in parts])[:-1]), strict=True):
        yield k, np.packbits(bits).tobytes()


def those(parts: list, answers: dict[int, list[bytes]], wanted: bool) -> np.ndarray:
    """The values of ``distinct_by_bucket`` that are shared (or not), by the answers of ``shared``."""
    out = [np.empty(0, dtype=np.uint64)]
    for b, distinct, _ in parts:
        bits = np.unpackbits(np.frombuffer(answers[b][0], dtype=np.uint8), count=len(distinct)).astype(bool)
        out.append(distinct[bits == wanted])
    return np.concatenate(out)


def edges(ordered: np.ndarray) -> np.ndarray:
    """Where each group of equal values begins."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    known = np.sort(known)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "double": pa.float64(), "boolean": pa.bool_()}


def arrow_schema(schema: str) -> pa.Schema:
    return pa.schema([(n, KINDS[k]) for n, k in (x.split() for x in schema.split(","))])


def packed(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = arrow_schema(schema)
    for at in range(0, len(rows), 4096):
        part = rows[at : at + 4096]
        columns = [pa.array(c, type=k) for c, k in zip(zip(*part, strict=True), kinds.types, strict=True)]
        yield pa.RecordBatch.from_arrays(columns, schema=kinds)


# --- hashes of substrings ------------------------------------------------------------------------------------------

ODD = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=4)
def byte_values(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Powers:
    """Powers of an odd number modulo 2**64, and of its inverse, as far as a worker has needed them."""

    def __init__(self, base: int):
        self.base = base
        self.there = self.back = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.there) < n:
            self.there, self.back = (
                np.append(np.uint64(1), np.cumprod(np.full(n, b, dtype=np.uint64)))
                for b in (self.base, pow(self.base, -1, 1 << 64))
            )
        return self.there[:n], self.back[:n]


POWERS = Powers(0xD1342543DE82EF95)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all (the finaliser of splitmix64, fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray, seed: int) -> np.ndarray:
    """Sums before each byte; ``span_hash`` reads the hash of any substring off them."""
    there, _ = POWERS.upto(len(data) + 1)
    out = np.empty(len(data) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(byte_values(seed)[data] * there[:-1], out=out[1:])
    return out


def span_hash(sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, back = POWERS.upto(len(sums))
    return mixed((sums[end] - sums[begin]) * back[begin] + (end - begin).astype(np.uint64) * ODD)


def words_of(data: np.ndarray, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of bytes that are no separators (a table of 256 flags)."""
    inside = np.concatenate([[False], ~separator[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[0::2], edge[1::2]


def by_bucket(values: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray]]:
    """The rows of sorted 64-bit values that fall into each of ``buckets`` equal ranges of the hash space."""
    if not len(values):
        return []
    which = ((values >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    cut = np.flatnonzero(np.diff(which, prepend=-1))
    stop = np.append(cut[1:], len(which))
    return [(int(which[a]), np.arange(a, b)) for a, b in zip(cut, stop, strict=True)]


def joined(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as maximal spans in order."""
    if not len(begin):
        return begin, end
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    first = np.append(True, begin[1:] > end[:-1])
    last = np.append(first[1:], True)
    return begin[first], end[last]

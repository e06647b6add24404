"""Document fingerprints from improbable features.

Every 64-byte window of a text is a candidate feature.  A window's entropy has some frequency over all windows of the
corpus; the rarer that level, the better the feature.  Among every 64 neighbouring windows the rarest is a winner, and
windows that win 16 times or more are selected.  Selected windows go into a chain of Bloom filters of 2048 bits and at most
160 features each.  The likeness of two digests is the overlap of their filters beyond what chance explains, normalised by
what it could be at most.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrials.llm import blocks as B

WINDOW = 64
LEVELS = 1000
NEIGHBOURS, WINS = 64, 16  # windows, of which one begins at each byte
BITS, HASHES, FEATURES = 2048, 5, 160
SEED = 5
CHUNK = 1 << 20
PIECE = 1 << 17  # bytes whose counts stay in a core's cache
MOST_PARTS = 2000
#: n * log2(n) in thousandths, for the counts of a byte in a window
TERMS = np.array([0] + [round(1000 * n * np.log2(n)) for n in range(1, WINDOW + 1)], dtype=np.int32)
STEP = np.diff(TERMS)  # what one more of a byte adds
FULL = WINDOW * 6000  # of 64 different bytes
LEVEL = ((FULL - np.arange(FULL + 1)) * LEVELS // FULL).astype(np.int16)
RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
    "near_next double"
)


def candidates(begins: np.ndarray, ends: np.ndarray, size: int, more: int = 0) -> np.ndarray:
    """Flags of the first ``size`` bytes: where a window, and ``more`` after it, lies within one text."""
    stop = ends - (WINDOW - 1 + more)
    some = stop > begins
    change = np.zeros(size + 1, dtype=np.int8)
    change[begins[some]] = 1
    change[stop[some]] = -1
    return np.cumsum(change[:-1], dtype=np.int8).view(bool)


def window_totals(data: np.ndarray) -> np.ndarray:
    """``TERMS`` of the counts of all byte values, summed, for the window at each place.

    A window differs from the one before it by one byte that leaves and one that enters.  What this changes depends only on
    how often the one stands in the 63 bytes after it, and the other in those before it.
    """
    many = len(data) - WINDOW + 1
    if many < 1:
        return np.zeros(0, dtype=np.int32)
    after, before = np.zeros(len(data), dtype=np.uint8), np.zeros(len(data), dtype=np.uint8)
    same = np.empty(PIECE, dtype=bool)
    for at in range(0, len(data), PIECE):
        for lag in range(1, WINDOW):
            other = data[at + lag : at + lag + PIECE]
            n = len(other)
            found = np.equal(data[at : at + n], other, out=same[:n]).view(np.uint8)
            after[at : at + n] += found
            before[at + lag : at + lag + n] += found
    out = np.empty(many, dtype=np.int32)
    out[0] = TERMS[np.bincount(data[:WINDOW])].sum()
    np.subtract(STEP[before[WINDOW:]], STEP[after[: many - 1]], out=out[1:])
    return np.cumsum(out, out=out)


def entropy_levels(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The entropy of the bytes of each window, 0 to ``LEVELS``."""
    return LEVEL[window_totals(data)[at]]


def level_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> np.ndarray:
    """How many candidate windows of the whole corpus have each entropy level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.in_chunks(batches, CHUNK):
            total = window_totals(block.data)
            n = np.bincount(LEVEL[total[candidates(block.begins, block.ends, len(total))]], minlength=LEVELS + 1)
            level = np.flatnonzero(n)
            yield from B.packed(list(zip(level.tolist(), n[level].tolist(), strict=True)), "level long, n long")

    out = np.zeros(LEVELS + 1, dtype=np.int64)
    counts = B.as_bytes(docs, key, text).mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n").alias("n"))
    for level, n in counts.collect():  # LEVELS + 1 rows at most
        out[level] = n
    return out


def precedence(counts: np.ndarray) -> np.ndarray:
    """A rank for each level, the rarest first; windows of hardly any entropy come last of all."""
    order = np.lexsort((np.arange(len(counts)), counts, np.arange(len(counts)) < LEVELS // 10))
    rank = np.empty(len(counts), dtype=np.int64)
    rank[order] = np.arange(len(counts))
    return rank


def selected(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Where the features begin: each text's rarest window, and those that are often the rarest of their neighbours."""
    total = window_totals(data)
    bits = len(total).bit_length()
    kind = np.int32 if bits <= 21 else np.int64  # a rank has ten bits
    score = (rank.astype(kind) << bits)[LEVEL][total]
    score |= np.arange(len(total), dtype=kind)
    place = kind((1 << bits) - 1)
    keep = np.zeros(len(total), dtype=bool)
    least, reach = score, 1
    while reach < NEIGHBOURS and len(least) > reach:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach == NEIGHBOURS:
        won = least[candidates(begins, ends, len(least), NEIGHBOURS - 1)] & place
        keep |= np.bincount(won, minlength=len(keep)) >= WINS
    some = ends - begins >= WINDOW
    if some.any():
        own = np.column_stack([begins[some], ends[some] - WINDOW + 1]).ravel()
        keep[np.minimum.reduceat(score, own)[::2] & place] = True
    return np.flatnonzero(keep)


def digests(texts: list[bytes], rank: np.ndarray) -> list[bytes]:
    """The chained filters of each text, 256 bytes each; none for an empty text."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    at = selected(data, begins, ends, rank)
    doc = np.searchsorted(ends, at, side="right")
    # a text shorter than a window is one feature
    short = np.flatnonzero((sizes > 0) & (sizes < WINDOW))
    begin = np.concatenate([at, begins[short]])
    end = np.concatenate([at + WINDOW, ends[short]])
    doc = np.concatenate([doc, short])
    order = np.argsort(doc, kind="stable")
    begin, end, doc = begin[order], end[order], doc[order]
    name = B.span_hash(B.prefix_sums(data, SEED), begin, end)
    many = np.bincount(doc, minlength=len(texts))
    chain = -(-many // FEATURES)
    base = np.cumsum(chain) - chain
    nth = np.arange(len(doc)) - (np.cumsum(many) - many)[doc]
    filter_ = base[doc] + nth // FEATURES
    bits = np.zeros(int(chain.sum()) * BITS, dtype=bool)
    for k in range(HASHES):
        bits[filter_ * BITS + ((name >> np.uint64(11 * k)) & np.uint64(BITS - 1)).astype(np.int64)] = True
    raw = np.packbits(bits).tobytes()
    width = BITS // 8
    return [raw[b * width : (b + c) * width] for b, c in zip(base.tolist(), chain.tolist(), strict=True)]


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, 0 for no more overlap than chance, and for an empty one against another."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    one, two = (np.frombuffer(x, dtype=np.uint64).reshape(-1, BITS // 64) for x in (a, b))
    if len(one) > len(two):
        one, two = two, one
    scores = _best(one, two)
    return float((scores.mean() + _best(two, one).mean()) / 2 if len(one) == len(two) else scores.mean())


def _best(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    mine, theirs = np.bitwise_count(one).sum(axis=1), np.bitwise_count(two).sum(axis=1)
    out = np.empty(len(one))
    for k, row in enumerate(one):
        common = np.bitwise_count(two & row).sum(axis=1).astype(float)
        chance = mine[k] * theirs / BITS
        out[k] = np.clip((common - chance) / np.maximum(np.minimum(mine[k], theirs) - chance, 1e-9), 0, 1).max()
    return out


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many of the following text."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its digest, that of its edited text, and the likeness of its digest to this one and to that
    of the next document in descending order of ids (after the last comes the first).

    A null text is empty; null ids come last, rows of one id in the order of their texts; a lone document is its own next.
    Rows are dealt out by ranges of ids, cut at quantiles; the first row of each range is also sent to the one before.
    """
    spark = docs.sparkSession
    rank = precedence(level_counts(docs, key, text))
    lowest = -(1 << 63)
    order = F.coalesce(F.col(key).cast("long"), F.lit(lowest))
    rows = docs.select(
        order.alias("id"), F.col(key).isNotNull().alias("real"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t")
    )
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = min(MOST_PARTS, 4 * tasks)
    cuts = sorted(set(rows.select(F.col("id").cast("double").alias("id")).approxQuantile("id", [k / parts for k in range(1, parts)], 0.2 / parts)))
    limits = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    dealt = rows.withColumn("part", F.size(F.filter(limits, lambda c: c > F.col("id"))))
    heads = dict(dealt.groupBy("part").agg(F.max("id")).collect())  # a row for each part
    full = sorted(heads)
    before = {heads[p]: full[k - 1] for k, p in enumerate(full)}
    again = (
        F.create_map(*[x for i, p in before.items() for x in (F.lit(i).cast("long"), F.lit(p))])
        if before
        else F.create_map().cast("map<bigint,int>")
    )
    sent = dealt.withColumn("head", F.lit(False)).unionByName(
        dealt.where(F.col("id").isin(list(before))).withColumn("part", again[F.col("id")]).withColumn("head", F.lit(True))
    )
    ordered = sent.repartition(tasks, "part").sortWithinPartitions("part", "head", F.desc("id"), "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream():
            for batch in batches:
                names = batch.schema.names
                yield from zip(*(batch.column(names.index(c)).to_pylist() for c in ("part", "head", "id", "real", "t")), strict=True)

        for _, part in groupby(stream(), key=lambda r: r[0]):
            held: list = []
            size = 0
            done = False
            for row in part:
                if done:
                    continue
                held.append(row)
                size += len(row[4])
                done = row[1]
                if done or size > CHUNK and len(held) > 1:
                    yield from B.packed(_compared(held, rank), RESULT)
                    held, size = held[-1:], len(row[4])

    return ordered.mapInArrow(run, RESULT).withColumnRenamed("doc_id", key)


def _compared(held: list, rank: np.ndarray) -> list[tuple]:
    """The results of all rows but the last, which is the next of the last but one."""
    texts = [r[4] for r in held]
    changed = [edited(t, n).encode() for t, n in zip(texts, texts[1:], strict=False)]
    own = digests([t.encode() for t in texts], rank)
    new = digests(changed, rank)
    out = []
    for k, (_, _, i, real, t) in enumerate(held[:-1]):
        out.append(
            (
                i if real else None,
                len(t),
                hashlib.sha256(changed[k]).hexdigest(),
                base64.b64encode(own[k]).decode(),
                base64.b64encode(new[k]).decode(),
                likeness(own[k], new[k]),
                likeness(own[k], own[k + 1]),
            )
        )
    return out

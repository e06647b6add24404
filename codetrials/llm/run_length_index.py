"""Deduplication of long byte strings over run-length compressed Burrows-Wheeler transforms.

A string of ``span`` bytes is found by its anchor, the k-mer of the smallest hash in it: equal strings have equal
anchors.  Spark groups the anchors of all texts; where an anchor stands once, no string that it anchors is repeated, so
only the surroundings of shared anchors go on.  They meet in buckets of anchor hashes, and a bucket builds its index:

1. each distinct segment once, with all its places, one after the other;
2. the Burrows-Wheeler transform of that text, run-length coded;
3. the longest common prefix of a suffix with its neighbours in suffix order, measured at the sampled run heads (with the
   one before) and run ends (with the one after) only: inside a run the match of the next text position is one shorter;
4. matching statistics, streamed along the text from the samples: how many bytes from here stand elsewhere too.

Positions whose statistic reaches ``span``, and all of a segment with two places, cover the bytes to remove.  A passage
that very many texts share is one distinct segment and few runs, however often it stands.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codetrials.llm import blocks as B

SPAN = 200
KMER = 32
SEED = 3
BLOCK_BYTES = 2 << 20
HOT = 256
ONCE, SHARED, CROWDED = 0, 1, 2
STRINGS = 1 << 40  # added to the bucket of answers about strings
PLACE_BITS = np.uint64(30)  # an anchor's place in its block
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


# --- the index of a bucket -----------------------------------------------------------------------------------------


def packed_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Seven 9-bit codes from each position on, as one number; 0 beyond the end, which is no code."""
    padded = np.append(codes.astype(np.int64), np.zeros(7, dtype=np.int64))
    out = np.zeros(n, dtype=np.int64)
    for j in range(7):
        out = (out << 9) | padded[j : j + n]
    return out


def suffix_order(keys: np.ndarray) -> np.ndarray:
    """The suffix array by prefix doubling; ``keys`` are the ``packed_codes``."""
    n = len(keys)
    order = np.argsort(keys).astype(np.int32)  # equal keys in any order: the rounds tell them apart
    ordered = keys[order]
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])).astype(np.int32)
    del ordered
    size = np.diff(np.append(first, n))
    rank = np.empty(n + 1, dtype=np.int32)
    rank[order] = np.repeat(first, size)
    rank[n] = -1
    slots = np.flatnonzero(np.repeat(size > 1, size)).astype(np.int32)
    reach = 7
    while len(slots):
        at = order[slots]
        key = (rank[at].astype(np.int64) << 32) + rank[np.minimum(at + reach, n)] + 1
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[slots] = at
        head = np.append(True, key[1:] != key[:-1])
        group = np.flatnonzero(head)
        size = np.diff(np.append(group, len(slots)))
        rank[at] = np.repeat(slots[group], size)
        slots = slots[np.repeat(size > 1, size)]
        reach *= 2
    return order


class RunLengthIndex:
    """Text of codes (a byte plus two, 1 after each segment), its runs and the matches at the runs' ends."""

    def __init__(self, codes: np.ndarray, most: int):
        self.codes, n = codes, len(codes)
        self.keys = packed_codes(codes, n)
        order = suffix_order(self.keys)
        before = np.where(order > 0, codes[order - 1].astype(np.int16), np.int16(-1))
        change = np.append(True, before[1:] != before[:-1])
        self.heads = np.flatnonzero(change)
        self.symbols = before[self.heads]
        self.lengths = np.diff(np.append(self.heads, n))
        head = self.heads[1:]
        # sampled suffixes at run heads, and at run ends, where a run's end and the next one's head have one common prefix
        match = np.append(self._common(order[head], order[head - 1], most), np.zeros(1, dtype=np.int64))
        self.head_at, self.head_match = np.append(order[head], order[:1]), match
        self.end_at, self.end_match = np.append(order[head - 1], order[-1:]), match

    def _common(self, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
        """The common prefix of the suffixes at ``a`` and ``b``, in steps of seven codes and then one by one."""
        n, out = len(self.codes), np.zeros(len(a), dtype=np.int64)
        live = np.arange(len(a))
        while len(live):
            p, q = a[live] + out[live], b[live] + out[live]
            inside = (p < n) & (q < n) & (out[live] < most)
            live, p, q = live[inside], p[inside], q[inside]
            same = self.keys[p] == self.keys[q]
            out[live[same]] += 7
            rest, p, q = live[~same], p[~same], q[~same]
            differ = self.keys[p] ^ self.keys[q]
            # the highest differing code of seven
            for j in range(6):
                going = (differ >> (9 * (6 - j))) == 0
                rest, differ = rest[going], differ[going]
                out[rest] += 1
            live = live[same]
        return out

    def statistics(self) -> np.ndarray:
        """For each text position, how many codes from it on stand elsewhere too (at least; exact up to ``most``)."""
        n = len(self.codes)
        return np.maximum(_streamed(n, self.head_at, self.head_match), _streamed(n, self.end_at, self.end_match))


def _streamed(n: int, at: np.ndarray, match: np.ndarray) -> np.ndarray:
    # a match that reaches code z from a sample is shorter by one at each place after it: it still reaches z
    reached = np.zeros(n, dtype=np.int32)
    reached[at] = at
    np.maximum.accumulate(reached, out=reached)
    stop = np.zeros(n, dtype=np.int32)
    stop[at] = at + match
    return stop[reached] - np.arange(n, dtype=np.int32)


def repeated_spans(segments: list[bytes], span: int) -> list[list[tuple[int, int]]]:
    """Per distinct segment, the maximal spans that strings of ``span`` bytes with another place in the index cover."""
    sizes = np.array([len(s) for s in segments], dtype=np.int64)
    text = np.frombuffer(b"\0".join(segments) + b"\0", dtype=np.uint8).astype(np.uint16) + 2
    stops = np.cumsum(sizes + 1) - 1
    text[stops] = 1
    begins = stops - sizes
    # segments are distinct, so no match holds a whole one between two ends: the longest goes over one end
    index = RunLengthIndex(text, 2 * int(sizes.max(initial=0)) + 2)
    start = np.flatnonzero(index.statistics() >= span)
    start = start[start + span <= stops[np.searchsorted(stops, start)]]
    a, z = B.joined(start, start + span)
    owner = np.searchsorted(stops, a)
    out: list = [[] for _ in segments]
    for k, x, y in zip(owner.tolist(), (a - begins[owner]).tolist(), (z - begins[owner]).tolist(), strict=True):
        out[k].append((x, y))
    return out


# --- anchors -------------------------------------------------------------------------------------------------------


def anchors(block: B.Block, span: int, kmer: int):
    """(hash, first byte, byte after the last) of the anchors and of all the strings that each one anchors; with the sums
    that ``span_hash`` reads."""
    none = np.empty(0, dtype=np.int64)
    n, wide = len(block.data), span - kmer + 1
    if n < span:
        return none.astype(np.uint64), none, none, none
    sums = B.prefix_sums(block.data, SEED)
    at = np.arange(n - kmer + 1)
    value = B.span_hash(sums, at, at + kmer)
    least = (value >> PLACE_BITS << PLACE_BITS) | at.astype(np.uint64)
    reach = 1
    while reach * 2 <= wide:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < wide:
        least = np.minimum(least[: len(least) - (wide - reach)], least[wide - reach :])
    size = np.maximum(block.lens - span + 1, 0)
    begins = block.begins[size > 0]
    size = size[size > 0]
    start = np.repeat(begins - (np.cumsum(size) - size), size) + np.arange(size.sum())
    if not len(start):
        return none.astype(np.uint64), none, none, sums
    anchor = (least[start] & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)
    head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    last = np.append(head[1:], len(start)) - 1
    # minima of a hash are small: mixed again, they fill all buckets alike
    return B.mixed(value[anchor[head]]), start[head], start[last] + span, sums


def counted(values: np.ndarray, buckets: int) -> list[tuple[int, np.ndarray, bytes]]:
    """(bucket, distinct values, 32-bit remainders of them and how often the block has each)."""
    distinct, n = np.unique(values, return_counts=True)
    brief = ((distinct * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(32)).astype(np.uint32)
    n = n.astype(np.uint32)
    return [(b, distinct[at], brief[at].tobytes() + n[at].tobytes()) for b, at in B.by_bucket(distinct, buckets)]


def classed(rows: list[tuple[int, bytes]]):
    """Answer each block, for each of its values in a bucket, whether it stands once, more often, or very often."""
    parts = [np.frombuffer(p, dtype=np.uint32).reshape(2, -1) for _, p in rows]
    names, n = np.concatenate(parts, axis=1)
    order = np.argsort(names, kind="stable")
    edge = B.edges(names[order])
    total = np.empty(len(names), dtype=np.int64)
    sums = np.add.reduceat(n[order].astype(np.int64), edge)
    total[order] = np.repeat(sums, np.diff(np.append(edge, len(order))))
    kind = np.where(total > HOT, CROWDED, np.where(total > 1, SHARED, ONCE)).astype(np.uint8)
    for (k, _), own in zip(rows, np.split(kind, np.cumsum([p.shape[1] for p in parts])[:-1]), strict=True):
        yield k, own.tobytes()


def of_class(parts: list, answers: dict[int, list[bytes]], least: int, most: int, shift: int = 0) -> np.ndarray:
    """The block's values whose class is from ``least`` to ``most``."""
    out = [np.empty(0, dtype=np.uint64)]
    for b, distinct, _ in parts:
        kind = np.frombuffer(answers[b + shift][0], dtype=np.uint8)
        out.append(distinct[(kind >= least) & (kind <= most)])
    return np.concatenate(out)


def _sent(block: B.Block, begin: np.ndarray, end: np.ndarray) -> bytes:
    raw = block.raw()
    head = np.concatenate([[len(begin)], begin, end]).astype(np.int64).tobytes()
    body = b"".join(raw[a:z] for a, z in zip(begin.tolist(), end.tolist(), strict=True))
    return zstandard.ZstdCompressor(level=3).compress(head + body)


def _unsent(payload: bytes):
    raw = zstandard.ZstdDecompressor().decompress(payload)
    n = int(np.frombuffer(raw[:8], dtype=np.int64)[0])
    begin, end = np.frombuffer(raw[8 : 8 + 16 * n], dtype=np.int64).reshape(2, n)
    stop = 8 + 16 * n + np.cumsum(end - begin)
    return begin.tolist(), [raw[z - w : z] for z, w in zip(stop.tolist(), (end - begin).tolist(), strict=True)]


def dedup(
    docs: DataFrame, span: int = SPAN, kmer: int = KMER, key: str = "doc_id", text: str = "text", keep_text: bool = False
) -> DataFrame:
    """One row per document: its bytes, how many of them strings of ``span`` bytes cover that start anywhere else too (in
    any document, at any other place), in how many maximal runs, and the hash of the bytes left; ``keep_text`` adds
    these as ``kept`` (binary).

    A null text is empty, and a text of less than ``span`` bytes keeps all.  Rows of one id are places of their own, so
    rows that are repeated lose their texts.  An empty table gives an empty result.
    """
    packed = B.pack(docs, key, text, BLOCK_BYTES)
    buckets, wide = B.bucket_count(packed, 1), B.bucket_count(packed, 8)
    copies = B.first_copies(packed)

    def anchored(block, answers):
        later, _ = B.copies_of(block, answers)
        value, begin, end, sums = anchors(block, span, kmer)
        own = ~later[np.searchsorted(block.ends, begin, side="right")]
        value, begin, end = value[own], begin[own], end[own]
        return value, begin, end, sums, counted(value, wide)

    def ask(block, answers):
        for b, _, brief in anchored(block, answers)[-1]:
            yield b, block.number, brief

    def crowded_strings(value, begin, end, sums, parts, answers):
        """Starts and hashes of the strings of the crowded anchors."""
        crowded = B.among(value, of_class(parts, answers, CROWDED, CROWDED))
        begin, size = begin[crowded], end[crowded] - span + 1 - begin[crowded]
        start = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return crowded, start, B.span_hash(sums, start, start + span) if len(start) else start.astype(np.uint64)

    def ask_strings(block, answers):
        _, _, name = crowded_strings(*anchored(block, answers), answers)
        for b, _, brief in counted(name, wide):
            yield b, block.number, brief

    def surroundings(block, answers):
        value, begin, end, sums, parts = anchored(block, answers)
        crowded, start, name = crowded_strings(value, begin, end, sums, parts, answers)
        alike = np.sort(start[B.among(name, of_class(counted(name, wide), answers, SHARED, CROWDED, STRINGS))])
        shared = B.among(value, of_class(parts, answers, SHARED, SHARED))
        owner = np.flatnonzero(crowded)
        # runs of consecutive starts, cut where the next anchor's strings begin
        cut = np.searchsorted(begin[owner], alike, side="right") - 1
        head = np.flatnonzero(np.append(True, (np.diff(alike) > 1) | (np.diff(cut) > 0))[: len(alike)])
        run_begin, run_end = alike[head], alike[np.append(head[1:], len(alike))[: len(head)] - 1] + span
        value = np.concatenate([value[shared], value[owner[cut[head]]]])
        begin, end = np.concatenate([begin[shared], run_begin]), np.concatenate([end[shared], run_end])
        order = np.argsort(value, kind="stable")
        for b, at in B.by_bucket(value[order], buckets):
            yield b, block.number, _sent(block, *B.joined(begin[order[at]], end[order[at]]))

    def search(rows):
        places: dict = {}
        for k, payload in rows:
            for begin, segment in zip(*_unsent(payload), strict=True):
                places.setdefault(segment, []).append((k, begin))
        found: dict = {}
        for (segment, where), spans in zip(places.items(), repeated_spans(list(places), span), strict=True):
            for k, begin in where:
                for a, z in [(0, len(segment))] if len(where) > 1 else spans:
                    found.setdefault(k, []).append((begin + a, begin + z))
        for k, spans in found.items():
            yield k, np.array(spans, dtype=np.int64).tobytes()

    def drop(block, answers):
        _, copied = B.copies_of(block, answers)
        whole = copied & (block.lens >= span)
        found = [np.frombuffer(p, dtype=np.int64).reshape(-1, 2) for b, ps in answers.items() if b != B.COPIES for p in ps]
        begin, end = np.concatenate([np.stack([block.begins[whole], block.ends[whole]], axis=1), *found]).T
        begin, end = B.joined(begin, end)
        raw = block.raw()
        lo = np.searchsorted(begin, block.begins).tolist()
        hi = np.searchsorted(begin, block.ends).tolist()
        begin, end = begin.tolist(), end.tolist()
        limits = zip(block.ids.tolist(), block.begins.tolist(), block.ends.tolist(), lo, hi, strict=True)
        for i, a, z, first, after in limits:
            cut = [a, *(x for k in range(first, after) for x in (begin[k], end[k])), z]
            kept = b"".join(raw[x:y] for x, y in zip(cut[::2], cut[1::2], strict=True))
            row = (None if i == B.NO_ID else i, z - a, z - a - len(kept), after - first, hashlib.sha256(kept).hexdigest())
            yield (*row, kept) if keep_text else row

    classes = B.answered(B.told(packed, copies, ask), classed)
    told = copies.unionByName(classes)
    strings = B.answered(B.told(packed, told, ask_strings), classed)
    told = told.unionByName(strings.withColumn("bucket", F.col("bucket") + STRINGS))
    spans = B.answered(B.told(packed, told, surroundings), search)
    return B.told(packed, copies.unionByName(spans), drop, RESULT + ", kept binary" * keep_text)

"""Substring deduplication by recompression.

Words are the letters of a long string.  A round names every maximal run of one symbol, then every pair of a left and a
right symbol; a symbol's side is a bit of its name.  A name is a hash of what the symbol stands for, so all tasks give
the same run or pair the same name without asking, and the parse of a substring depends on its own words except near its
ends.  Each symbol carries the range of words that its being there depends on: wherever these words stand, the symbol
stands.  After ``rounds`` rounds

1. Spark groups the names of all texts (copies of a whole text apart, which lose all their windows); a name that one
   document alone has (``private``) disproves every window that holds its whole range: no other document has that window;
2. all other windows are named exactly, by 96 bits, and Spark finds for each name the smallest document that has it;
3. each document drops the words of its windows that a smaller document has too.

Step 1 sends four bytes a distinct symbol of a block, and step 2 runs only over text that shared symbols reveal.  The 31-bit remainders that
stand for names in step 1 can only make a private symbol look shared, which step 2 sets right.
"""

from __future__ import annotations

import hashlib

import numpy as np
import zstandard
from pyspark.sql import DataFrame

from codetrials.llm import blocks as B

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ROUNDS = 3
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
WORD_SEED, CHECK_SEED = 1, 2


def recompressed(names: np.ndarray, doc: np.ndarray, rounds: int, run_rounds: int = 1):
    """(name, low, high) of the symbols after ``rounds`` rounds over words ``names`` of documents ``doc``.

    low and high are the first and last word that the symbol depends on; a symbol next to a document's end depends on a
    word outside it, so that no window of that document holds its range.  Runs are named in the first ``run_rounds``
    rounds: a later one would widen the ranges beyond a window of 13 words.
    """
    low = np.arange(len(names))
    high = low.copy()
    for r in range(rounds):
        if len(names) < 2:
            break
        if r < run_rounds:
            same = (names[1:] == names[:-1]) & (doc[1:] == doc[:-1])
            first = np.flatnonzero(np.append(True, ~same))
            last = np.append(first[1:], len(names)) - 1
            size = (last - first + 1).astype(np.uint64)
            before, after = _beyond(low, high, doc, first, last)
            names = np.where(size > 1, B.mixed(names[first] + size * B.ODD), names[first])
            low, high, doc = before, after, doc[first]
        left = (names >> np.uint64(17 + r)) & np.uint64(1) == 0
        pair = np.append((left[:-1] & ~left[1:]) & (doc[1:] == doc[:-1]), False)
        second = np.append(False, pair[:-1])
        before, after = _beyond(low, high, doc, np.arange(len(names)), np.arange(len(names)))
        # a pair stands by itself; a left symbol alone needs to see its next, a right one its previous
        lone_low, lone_high = np.where(left, low, before), np.where(left, after, high)
        nxt = np.append(names[1:], np.uint64(0))
        nxt_high = np.append(high[1:], 0)
        names = np.where(pair, B.mixed(names * np.uint64(3) ^ B.mixed(nxt + np.uint64(r + 1))), names)
        low, high = np.where(pair, low, lone_low), np.where(pair, nxt_high, lone_high)
        keep = ~second
        names, low, high, doc = names[keep], low[keep], high[keep], doc[keep]
    return names, low, high


def _beyond(low, high, doc, first, last):
    """The low end of the symbol before ``first`` and the high end of the one after ``last``; outside if there is none."""
    n = len(low)
    p, q = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    has_p, has_q = (first > 0) & (doc[p] == doc[first]), (last < n - 1) & (doc[q] == doc[last])
    return np.where(has_p, low[p], low[first] - 1), np.where(has_q, high[q], high[last] + 1)


class Words:
    """The words of a block, their symbols and their windows."""

    def __init__(self, block: B.Block, window: int, rounds: int):
        self.block, self.window = block, window
        self.begin, self.end = B.words_of(block.data, SPACE)
        self.doc = np.searchsorted(block.ends, self.begin, side="right")
        self.hash = B.span_hash(B.prefix_sums(block.data, WORD_SEED), self.begin, self.end)
        self.first_of = np.searchsorted(self.doc, np.arange(len(block.ids)))
        self.after_of = np.searchsorted(self.doc, np.arange(len(block.ids)), side="right")
        self.rounds = rounds

    def symbols(self):
        name, low, high = recompressed(self.hash, self.doc, self.rounds)
        at = np.maximum(low, 0)
        last = np.minimum(high, len(self.doc) - 1)
        whole = (low >= 0) & (high < len(self.doc)) & (high - low < self.window)
        whole[whole] = self.doc[at[whole]] == self.doc[last[whole]]
        return name[whole], low[whole], high[whole]

    def starts(self) -> np.ndarray:
        """Which words start a window."""
        at = np.arange(len(self.doc))
        return at + self.window <= self.after_of[self.doc]

    def window_names(self, at: np.ndarray) -> np.ndarray:
        """64-bit names of the windows that start at words ``at``."""
        return self._folded(self.hash, at)

    def window_checks(self, at: np.ndarray) -> np.ndarray:
        """32 more bits, of other hashes of the words."""
        check = B.span_hash(B.prefix_sums(self.block.data, CHECK_SEED), self.begin, self.end)
        return (self._folded(check, at) >> np.uint64(32)).astype(np.uint32)

    def without(self, removed: np.ndarray, keep_text: bool):
        """The result rows if the words ``removed`` go."""
        data = np.append(self.block.data, np.uint8(0x20))
        data[self.end] = 0x20
        steps = np.zeros(len(data) + 1, dtype=np.int8)
        steps[self.begin[~removed]] += 1
        steps[self.end[~removed] + 1] -= 1
        left = data[np.cumsum(steps[:-1], dtype=np.int8) > 0].tobytes()
        size = np.append(0, np.cumsum(np.where(removed, 0, self.end - self.begin + 1)))
        gone = np.append(0, np.cumsum(removed))
        for k, i in enumerate(self.block.ids.tolist()):
            a, z = self.first_of[k], self.after_of[k]
            kept = left[size[a] : max(size[a], size[z] - 1)]
            row = (None if i == B.NO_ID else i, int(z - a), int(gone[z] - gone[a]), hashlib.sha256(kept).hexdigest())
            yield (*row, kept.decode() if self.block.lens[k] >= 0 else None) if keep_text else row

    def _folded(self, values: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), dtype=np.uint64)
        for j in range(self.window):
            out = out * np.uint64(0xD6E8FEB86659FD93) + values[at + j]
        return B.mixed(out)


def _elsewhere(rows):
    """Answer each block with the names of its windows that a smaller document outside it has."""
    parts = [_unsent(p) for _, p in rows]
    name, check, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(name, kind="stable")
    edge = B.edges(name[order])
    group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
    if (np.maximum.reduceat(check[order], edge) != np.minimum.reduceat(check[order], edge)).any():
        # two windows of one 64-bit name: tell them apart by the other 32 bits
        order = np.lexsort((check, name))
        differs = (np.diff(name[order]) != 0) | (np.diff(check[order].astype(np.int64)) != 0)
        edge = np.flatnonzero(np.append(True, differs))
        group = np.repeat(np.arange(len(edge)), np.diff(np.append(edge, len(order))))
    gone = np.empty(len(name), dtype=bool)
    gone[order] = np.minimum.reduceat(ids[order], edge)[group] < ids[order]
    at = 0
    for (k, _), (own, _, _) in zip(rows, parts, strict=True):
        yield k, np.sort(own[gone[at : at + len(own)]]).tobytes()
        at += len(own)


def _sent(name, check, ids) -> bytes:
    """Ids as the byte planes of their distance from the smallest, checks and sorted names, compressed."""
    low = ids.min()
    planes = (ids - low).astype(np.uint64).view(np.uint8).reshape(-1, 8).T
    head = np.array([len(name), low], dtype=np.int64).tobytes()
    body = head + np.ascontiguousarray(planes).tobytes() + check.tobytes() + name.tobytes()
    return zstandard.ZstdCompressor(level=1).compress(body)


def _unsent(payload: bytes):
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(payload), dtype=np.uint8)
    n, low = raw[:16].view(np.int64)
    wide = np.ascontiguousarray(raw[16 : 16 + 8 * n].reshape(8, n).T).view(np.uint64).ravel()
    check = raw[16 + 8 * n : 16 + 12 * n].copy().view(np.uint32)
    return raw[16 + 12 * n :].copy().view(np.uint64), check, wide.astype(np.int64) + low


def dedup(
    docs: DataFrame,
    window: int = 13,
    rounds: int = ROUNDS,
    key: str = "doc_id",
    text: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """One row per document: its words, how many of them a window of a document with a smaller id covers, and the hash
    of what is left; ``keep_text`` adds the words left, joined by one space, as ``kept`` (null for a null text).

    A null text has no words.  A null id counts as larger than any other; documents of one id, repeated rows too, do not
    remove each other's words.  Texts of less than ``window`` words keep all.  An empty table gives an empty result.
    """
    packed = B.pack(docs, key, text)
    buckets = B.bucket_count(packed)
    copies = B.first_copies(packed)

    def names_of(words, copy):
        name, low, high = words.symbols()
        own = ~copy[words.doc[low]]
        ids = words.block.ids[words.doc[low]]
        return name, low, high, B.distinct_by_bucket(name[own], ids[own], buckets)

    def ask(block, answers):
        copy, _ = B.copies_of(block, answers)
        for b, _, brief in names_of(Words(block, window, rounds), copy)[-1]:
            yield b, block.number, brief.tobytes()

    def suspects(block, answers):
        """Windows of no private symbol, by the bucket of their names, each with its smallest document."""
        words, (copy, _) = Words(block, window, rounds), B.copies_of(block, answers)
        name, low, high, parts = names_of(words, copy)
        private = B.among(name, B.those(parts, answers, False))
        steps = np.zeros(len(words.doc) + 1, dtype=np.int32)
        np.add.at(steps, np.maximum(high[private] - window + 1, 0), 1)
        np.add.at(steps, low[private] + 1, -1)
        at = np.flatnonzero(words.starts() & (np.cumsum(steps[:-1]) == 0) & ~copy[words.doc])
        if not len(at):
            return
        entry, check, ids = words.window_names(at), words.window_checks(at), block.ids[words.doc[at]]
        order = np.lexsort((ids, entry))
        order = order[B.edges(entry[order])]
        entry, check, ids = entry[order], check[order], ids[order]
        for b, rows in B.by_bucket(entry, buckets):
            yield b, block.number, _sent(entry[rows], check[rows], ids[rows])

    def drop(block, answers):
        words, (copy, _) = Words(block, window, rounds), B.copies_of(block, answers)
        at = np.flatnonzero(words.starts() & ~copy[words.doc])
        entry, ids = words.window_names(at), block.ids[words.doc[at]]
        order = np.argsort(entry, kind="stable")
        edge = B.edges(entry[order])
        first = np.empty(len(at), dtype=np.int64)
        first[order] = np.repeat(np.minimum.reduceat(ids[order], edge), np.diff(np.append(edge, len(at)))) if len(at) else []
        known = [np.frombuffer(p, dtype=np.uint64) for b, ps in answers.items() if b != B.COPIES for p in ps]
        again = at[(first < ids) | B.among(entry, np.concatenate([np.empty(0, dtype=np.uint64), *known]))]
        again = np.concatenate([again, np.flatnonzero(words.starts() & copy[words.doc])])
        gone = np.zeros(len(words.doc) + 1, dtype=np.int64)
        np.add.at(gone, again, 1)
        np.add.at(gone, again + window, -1)
        yield from words.without(np.cumsum(gone[:-1]) > 0, keep_text)

    names = B.answered(B.told(packed, copies, ask), B.shared)
    windows = B.answered(B.told(packed, copies.unionByName(names), suspects), _elsewhere)
    return B.told(packed, copies.unionByName(windows), drop, RESULT + ", kept string" * keep_text)

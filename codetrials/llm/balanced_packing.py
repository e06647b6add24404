"""Cost-balanced packing of documents into training sequences.

The cost of a piece of n tokens is estimated as linear (projections) plus quadratic (attention): n + n * n / (6 * width).
A task gathers pieces until they fill ``GROUP_TOKENS`` tokens, and packs them: in descending order of cost, each goes to the
sequence of lowest cost that has room for it.  A piece that fits nowhere is cut: the sequence of lowest cost with any room
takes what it can, and the rest waits for its turn in the order.  Whole sequences of a document longer than one
go first, being the costliest.

The room of a group is its tokens: as many full sequences as they fill, and what is left over in sequences of powers of
two, which are not padded.  So nothing is padded, and a group has at most eleven short sequences.

All pieces of a document are made by the task that reads it: there is no shuffle, no row is held longer than its group,
and a task that is run again gives whole documents again, whatever the order of its rows.  Sequences are numbered from
the task's number.

Defined cases: a null or empty text is its end token alone.  Repeated rows are documents of their own.  A null id is kept.
Bytes that are not UTF-8 become U+FFFD.  An empty table gives no rows.  Columns other than id and text are not read.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEQUENCE = 2048
GROUP_TOKENS = 1 << 22
WIDTH = 1024  # of the model whose cost is balanced
END = 1  # the id that ends a document
TOKENIZER = "byte_bpe_50k.json"
SEQUENCE_BITS = 40  # sequences of a task
CHUNK = 1 << 20  # characters that are encoded at once, if they can be parted

#: Latin letters, digits beyond ASCII, and other marks whose class is the same in every version of Unicode.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ſ"
DIGITS = "0-9²³¹¼½¾"
MARKS = "!-/:-@[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€"
BLANKS = " \t\n\r"
PLAIN = re.compile(f"[{BLANKS}{LETTERS}{DIGITS}{MARKS}]*")
#: Fixed value: how byte-level tokenizers part a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
GAP = re.compile(r"(?<=\S)(?= \S)")  # where a text can be parted without changing its words


def byte_level(config: dict) -> bool:
    """Whether a tokenizer parts texts into ``WORDS`` and merges the bytes of each by themselves."""
    parts, model = config.get("pre_tokenizer") or {}, config.get("model") or {}
    plain = parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space")
    odd = ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    rest = [config.get(x) for x in ("normalizer", "post_processor", "truncation", "padding")]
    return bool(plain) and model.get("type") == "BPE" and not any(rest) and not any(model.get(x) for x in odd)


def bytes_of_marks() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others for
    the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """The ids that the tokenizers library gives for a text.

    Where the file allows, plain texts take a shorter way to the same ids: merging the neighbours of least rank needs only
    the vocabulary, if merges are numbered in their order and the library makes every entry out of its own bytes.  Both
    are asked of the library when the file is loaded; if either fails, or for a text with a special token or a character
    whose class may differ, the library encodes the text itself.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        with open(path) as f:
            config = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.specials = [x["content"] for x in config.get("added_tokens", ())]
        self.by_words = byte_level(config)
        self.ranked = self._ranked(config["model"]) if self.by_words else None

    def _ranked(self, model: dict):
        try:
            import tiktoken
        except ImportError:
            return None
        vocab = {w: k for w, k in model["vocab"].items() if w not in self.specials}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [vocab.get(a + b, -1) for a, b in merges]
        of = bytes_of_marks()
        single = [vocab.get(c, -1) for c in of]
        whole = all([t.id for t in self.library.model.tokenize(w)] == [k] for w, k in vocab.items())
        if not whole or made != sorted(made) or min(single) < 0 or max(single) >= min(made) or len(made) + len(single) != len(vocab):
            return None
        ranks = {bytes(of[c] for c in w): k for w, k in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if len(text) <= CHUNK or not self.by_words:
            return self._part(text)
        return np.concatenate([self._part(x) for x in self._parts(text)])

    def _parts(self, text: str) -> Iterator[str]:
        begin = 0
        while len(text) - begin > CHUNK and (gap := GAP.search(text, begin + CHUNK)):
            yield text[begin : gap.start()]
            begin = gap.start()
        yield text[begin:]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _part(self, text: str) -> np.ndarray:
        if self.ranked is None or not PLAIN.fullmatch(text) or any(x in text for x in self.specials):
            return self._whole(text)
        return np.array(self.ranked.encode_ordinary(text), dtype=np.uint32)


@lru_cache(maxsize=4)
def encoder(tokenizer: str) -> Encoder:
    """``tokenizer``: a file's path, or the name of one of the installed public tokenizers."""
    if os.path.sep in tokenizer:
        return Encoder(tokenizer)
    import public_tokenizers

    return Encoder(public_tokenizers.path(tokenizer))


def cost(tokens: np.ndarray | int, width: int = WIDTH):
    return tokens + tokens * tokens / (6.0 * width)


def room(tokens: int, size: int = SEQUENCE) -> np.ndarray:
    """Sequences that hold exactly ``tokens``: full ones, then the powers of two of what is left."""
    rest = tokens % size
    return np.array([size] * (tokens // size) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1], dtype=np.int64)


def assign(lengths: Sequence[int], size: int = SEQUENCE, width: int = WIDTH) -> tuple[list[tuple[int, int, int, int, int]], np.ndarray]:
    """(item, start, length, sequence, offset) of each piece, and the cost of each sequence.

    Every sequence of ``room`` is filled to the end.
    """
    left = room(sum(lengths), size)
    filled, costs = np.zeros(len(left), dtype=np.int64), np.zeros(len(left))
    waiting = [(-n, k, 0) for k, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    pieces = []
    while waiting:
        n, item, start = heapq.heappop(waiting)
        n = -n
        fits = left >= n
        if not fits.any():
            fits = left > 0
        at = int(np.where(fits, costs, np.inf).argmin())
        taken = min(n, int(left[at]))
        pieces.append((item, start, taken, at, int(filled[at])))
        left[at] -= taken
        filled[at] += taken
        costs[at] += cost(taken, width)
        if taken < n:
            heapq.heappush(waiting, (taken - n, item, start + taken))
    return pieces, costs


class Packer:
    """Gathers the documents of one task and gives the pieces of each group as it fills."""

    def __init__(self, number: int, encode: Encoder, end: int, size: int, width: int, group: int):
        self.next, self.encode = number << SEQUENCE_BITS, encode
        self.end, self.size, self.width, self.group = np.array([end], dtype=np.uint32), size, width, group
        self.held: list[tuple[object, int, int, np.ndarray]] = []
        self.tokens = 0
        self.rows: list[tuple] = []

    def _piece(self, key: object, start: int, ids: np.ndarray, tokens: int, sequence: int, offset: int, length: int, cost: float) -> None:
        crc = zlib.crc32(ids.astype("<u4").tobytes())
        self.rows.append((key, start, len(ids), crc, tokens, sequence, offset, length, cost))

    def add(self, key: object, text: str) -> None:
        ids = np.concatenate([self.encode.ids(text), self.end])
        whole = len(ids) // self.size * self.size
        for start in range(0, whole, self.size):
            self._piece(key, start, ids[start : start + self.size], len(ids), self.next, 0, self.size, cost(self.size, self.width))
            self.next += 1
        if whole < len(ids):
            self.held.append((key, whole, len(ids), ids[whole:].copy()))
            self.tokens += len(ids) - whole
        if self.tokens >= self.group:
            self.pack()

    def pack(self) -> None:
        pieces, costs = assign([len(x[3]) for x in self.held], self.size, self.width)
        sizes = np.zeros(len(costs), dtype=np.int64)
        for _, _, n, at, _ in pieces:
            sizes[at] += n
        for item, start, n, at, offset in pieces:
            key, begin, tokens, ids = self.held[item]
            self._piece(key, begin + start, ids[start : start + n], tokens, self.next + at, offset, int(sizes[at]), float(costs[at]))
        self.next += len(costs)
        self.held, self.tokens = [], 0

    def taken(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


COLUMNS = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long, sequence_cost double"
)


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    tokenizer: str = TOKENIZER,
    end: int = END,
    size: int = SEQUENCE,
    width: int = WIDTH,
    group: int = GROUP_TOKENS,
) -> DataFrame:
    """A row per piece: id, ``start`` and ``length`` in the document's ids, their CRC-32, the document's tokens, the
    sequence, the piece's offset in it, and the sequence's length and estimated cost."""
    kind = docs.schema[key].dataType.simpleString()
    slim = docs.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("body"))
    names = ["key", *[x.split()[0] for x in COLUMNS.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), encoder(tokenizer), end, size, width, group)
        kinds = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            kinds = [batch.schema.field(0).type, *[pa.int64()] * 7, pa.float64()]
            for k, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(k, (body.as_py() or b"").decode(errors="replace"))
                if len(packer.rows) >= 10_000:
                    yield out(packer.taken())
        packer.pack()
        if packer.rows:
            yield out(packer.taken())

    return slim.mapInArrow(run, f"key {kind}, {COLUMNS}").withColumnRenamed("key", key)

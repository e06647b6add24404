"""Fuzzy search for short licence notices.

A notice with at most k edits is cut into k + 1 pieces; by the pigeonhole principle one of them stands unchanged in every
match, so exact seeds find all candidates, and the regex library's bounded-error matching verifies the surroundings of
each seed and reports the span and its edits.  Texts are compared as lower-cased words joined by single blanks.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from codetrials.llm import blocks as B


@dataclass(frozen=True)
class Notice:
    phrase: str
    label: str
    edits: int
    base: bool


#: The base phrases and their labels.
BASE = [
    Notice("gnu general public license", "gpl", 2, True),
    Notice("apache license", "apache", 1, True),
    Notice("cc by", "cc-by", 0, True),
    Notice("mit license", "mit", 1, True),
]
MORE = [
    Notice("creative commons attribution", "cc-by", 2, False),
    Notice("mozilla public license", "mpl", 2, False),
    Notice("bsd license", "bsd", 1, False),
]
RESULT = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans string"
)


def seeds(phrase: str, edits: int) -> list[tuple[int, bytes]]:
    """(offset, piece) of ``edits + 1`` pieces of about one length."""
    cut = [round(len(phrase) * k / (edits + 1)) for k in range(edits + 2)]
    return [(a, phrase[a:z].encode()) for a, z in zip(cut, cut[1:], strict=False)]


def plain(block: B.Block):
    """(words joined by blanks, with a line feed first and after each text's last one; where each word begins; first word
    of each text; the word after its last)."""
    data = np.append(B.LOWER[block.data], np.uint8(0x20))
    begin, end = B.words_of(data[:-1], B.MARKS)
    doc = np.searchsorted(block.ends, begin, side="right")
    data[end] = 0x20
    last = np.append(doc[1:] != doc[:-1], True) if len(doc) else np.empty(0, dtype=bool)
    data[end[last]] = 0x0A
    steps = np.zeros(len(data) + 1, dtype=np.int8)
    steps[begin] += 1
    steps[end + 1] -= 1
    at = np.cumsum(end - begin + 1) - (end - begin + 1) + 1
    docs = np.arange(len(block.ids))
    text = b"\n" + data[np.cumsum(steps[:-1], dtype=np.int8) > 0].tobytes()
    return text, at, np.searchsorted(doc, docs), np.searchsorted(doc, docs, side="right")


def exact(text: bytes, phrase: bytes) -> list[int]:
    """All places where the words of ``phrase`` stand one after the other."""
    out, at = [], text.find(phrase)
    while at >= 0:
        z = at + len(phrase)
        if (at == 0 or text[at - 1] in b" \n") and (z == len(text) or text[z] in b" \n"):
            out.append(at)
        at = text.find(phrase, at + 1)
    return out


def window(text: bytes, at: int, a: int, z: int) -> tuple[int, int]:
    """The outermost separators (blanks, line feeds) of ``text[a:z]`` and the bytes around it, within the text of a document
    that has ``at``; a match is whole words, so it lies between them."""
    a, z = max(a, text.rfind(b"\n", 0, at) + 1), min(z, text.find(b"\n", at))
    left = a - 1 if text[a - 1] in b" \n" else text.find(b" ", a, z)
    right = z if text[z] in b" \n" else text.rfind(b" ", a, z)
    return left, right


def fuzzy(text: bytes, notice: Notice) -> list[tuple[int, int, int]]:
    """(begin, end, edits) of the matches with at most ``notice.edits`` edits, best first at each place.

    ``text`` is framed as by :func:`plain`, and nothing depends on where a document stands in it.
    """
    if not notice.edits:
        return [(at, at + len(notice.phrase), 0) for at in exact(text, notice.phrase.encode())]
    pattern = regex.compile(rf"(?b)(?<=[ \n])(?=[^ \n])(?:{notice.phrase}){{e<={notice.edits}}}(?<=[^ \n])(?=[ \n])".encode())
    found: dict[int, tuple[int, int, int]] = {}
    for offset, piece in seeds(notice.phrase, notice.edits):
        at = text.find(piece)
        while at >= 0:
            begin = at - offset
            left, right = window(text, at, begin - notice.edits, begin + len(notice.phrase) + notice.edits)
            if 0 <= left < right and (m := pattern.search(text[left : right + 1])):
                begin, end, n = m.start() + left, m.end() + left, sum(m.fuzzy_counts)
                if begin not in found or n < found[begin][2]:
                    found[begin] = (begin, end, n)
            at = text.find(piece, at + 1)
    return sorted(found.values())


def search(docs: DataFrame, notices: list[Notice] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its words, the exact places of base notices, labels (base, and with those of fuzzy matches),
    the closeness of the best match (1 without an edit, 0 without a match) and all spans as label:first word:word after
    the last:edits.

    A null text has no words.  Repeated rows each have a result; an empty table gives an empty result.
    """
    notices = BASE + MORE if notices is None else notices

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in B.in_chunks(batches):
            yield from B.packed(list(_rows(block, notices)), RESULT)

    return B.as_bytes(docs, key, text).mapInArrow(run, RESULT)


def _rows(block: B.Block, notices: list[Notice]):
    text, at, first, after = plain(block)
    first, after = first.tolist(), after.tolist()
    starts = at.tolist()
    places: dict[int, list] = {}
    words = np.array(first)
    for notice in notices:
        hits = [(a, a + len(notice.phrase), 0) for a in exact(text, notice.phrase.encode())] if notice.base else []
        exactly = {a for a, _, _ in hits}
        for begin, end, edits in hits + [h for h in fuzzy(text, notice) if h[0] not in exactly]:
            word = bisect_right(starts, begin) - 1
            # the first words of texts ascend, those without words share the next one's
            doc = int(np.searchsorted(words, word, side="right")) - 1
            base = notice.base and begin in exactly
            stop = bisect_right(starts, end - 1)
            places.setdefault(doc, []).append((word - first[doc], stop - first[doc], edits, notice, base))
    for k, i in enumerate(block.ids.tolist()):
        mine = sorted(places.get(k, []), key=lambda p: (p[0], p[3].label, p[1]))
        base = [p[0] for p in mine if p[4]]
        yield (
            B.real_id(i),
            after[k] - first[k],
            len(base),
            min(base, default=None),
            max(base, default=None),
            ",".join(sorted({p[3].label for p in mine if p[4]})),
            ",".join(sorted({p[3].label for p in mine})),
            max((1 - p[2] / len(p[3].phrase) for p in mine), default=0.0),
            ",".join(f"{p[3].label}:{p[0]}:{p[1]}:{p[2]}" for p in mine),
        )

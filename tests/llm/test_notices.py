"""Fuzzy notices against edit distances, wherever a document stands in its block."""

from __future__ import annotations

import random

import pytest

from codetrials.llm import notice_search, queries


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def nearest(words: list[str], phrase: str, most: int) -> int | None:
    """Least edits from ``phrase`` to whole words one after the other."""
    best = None
    for a in range(len(words)):
        text = ""
        for w in words[a:]:
            text += (" " if text else "") + w
            if len(text) > len(phrase) + most:
                break
            if len(text) >= len(phrase) - most and (d := distance(text, phrase)) <= most and (best is None or d < best):
                best = d
    return best


def mutated(draw, text):
    for _ in range(draw.randrange(4)):
        k = draw.randrange(len(text) + 1)
        text = draw.choice([text[:k] + text[k + 1 :], text[:k] + draw.choice("aeit ") + text[k:], text[:k] + draw.choice("xoe") + text[k + 1 :]])
    return " ".join(text.split())


def cases():
    draw = random.Random(9)
    notices = notice_search.BASE + notice_search.MORE
    texts = ["li mit the iygnu general public license e", "iygnu general public license and more", "a iygnu general public license", "", "it license", "mit", "license", "x" * 5000 + "mit license"]
    for _ in range(400):
        parts = [draw.choice(["", "the", "a li mit", "under the", "e", "x" * 30, "mit"]) for _ in range(draw.randrange(3))]
        parts.insert(draw.randrange(len(parts) + 1), mutated(draw, draw.choice(notices).phrase))
        texts.append(" ".join(p for p in parts if p))
    return texts


@pytest.mark.parametrize("rows", [1, 7, 10_000])
def test_labels_scores_and_spans(spark, rows):
    queries.known_to_workers(spark)
    texts = cases()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
        found = {r.doc_id: r for r in notice_search.search(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    notices = notice_search.BASE + notice_search.MORE
    for k, text in enumerate(texts):
        words = text.split()
        near = [(n, nearest(words, n.phrase, n.edits)) for n in notices]
        labels = sorted({n.label for n, d in near if d is not None})
        assert found[k].labels == ",".join(labels), text
        best = max((1 - d / len(n.phrase) for n, d in near if d is not None), default=0.0)
        assert found[k].score == pytest.approx(best), text
        for span in filter(None, found[k].spans.split(",")):
            label, a, z, edits = span.split(":")
            passage = " ".join(words[int(a) : int(z)])
            assert int(edits) in {distance(passage, n.phrase) for n in notices if n.label == label}, (text, span)


def test_windows_end_at_words():
    text = b"\nab cd ef\ngh ij\n"
    assert notice_search.window(text, 4, 2, 8) == (3, 6)
    assert notice_search.window(text, 4, 1, 9) == (0, 9)
    assert notice_search.window(text, 11, 0, 99) == (9, 15)

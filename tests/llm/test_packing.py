"""Packing: exact round trip to the library's ids, full sequences, and the rule of assignment."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")

from codetrials.llm import balanced_packing, queries  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(library, text):
    return np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


def check(rows, docs, library, size=2048):
    """Every id once, offsets without gaps, no padding."""
    spans, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        spans[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    want = defaultdict(int)
    for i, t in docs:
        ids = ids_of(library, t)
        want[i, len(ids)] += len(ids)
    assert {k: sum(r.length for r in v) for k, v in spans.items()} == want
    by_id = {i: ids_of(library, t) for i, t in docs}
    if len(by_id) == len(docs):
        for (i, n), v in spans.items():
            at = 0
            for r in sorted(v, key=lambda r: r.start):
                assert r.start == at and r.length > 0 and n == len(by_id[i])
                at += r.length
                assert r.ids_crc32 == zlib.crc32(by_id[i][r.start : at].tobytes())
            assert at == n
    for v in sequences.values():
        at = 0
        for r in sorted(v, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == v[0].sequence_length and at <= size and (at == size or at & (at - 1) == 0)
        cost = sum(float(balanced_packing.cost(r.length)) for r in v)
        assert v[0].sequence_cost == pytest.approx(cost)


def test_whole_query(spark, library):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]
    rows = queries.op12_balanced_packing(spark, SMALL).collect()
    check(rows, docs, library)
    assert len({r.doc_id for r in rows}) == len(docs)


def test_hard_cases(spark, library):
    draw = random.Random(1)
    odd = "ab c'stdéß 12\n\t  .,;中 \x1c²ⅷ\U0001f600"
    texts = [None, "", " ", "a", "word " * 5000, "x" * 9000, "<|endoftext|> and <|endoftext|>"]
    texts += ["".join(draw.choice(odd) for _ in range(draw.randrange(3000))) for _ in range(60)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "no id")]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in docs], "doc_id long, text string, start int, key string").repartition(3)
    queries.known_to_workers(spark)
    check(balanced_packing.pack(df).collect(), docs, library)
    check(balanced_packing.pack(df, group=5000).collect(), docs, library)
    again = df.unionByName(df.where("doc_id = 4"))
    check(balanced_packing.pack(again).collect(), [*docs, docs[4]], library)
    assert balanced_packing.pack(df.limit(0)).collect() == []
    named = balanced_packing.pack(df.selectExpr("concat('d', doc_id) as doc_id", "text")).collect()
    assert {r.doc_id for r in named} == {None} | {f"d{k}" for k in range(len(texts))}


def test_all_given_texts_get_the_library_s_ids(spark, library):
    encode = balanced_packing.encoder(balanced_packing.TOKENIZER)
    assert encode.ranked is not None
    texts = [r.text or "" for r in queries.table(spark, "/root/testdata/sf0.01", "documents").select("text").collect()]
    assert all(encode.ids(t).tolist() == library.encode(t, add_special_tokens=False).ids for t in texts)
    assert sum(bool(balanced_packing.PLAIN.fullmatch(t)) for t in texts) > 0.5 * len(texts)


def test_a_vocabulary_whose_entries_the_library_does_not_make_is_left_to_it(library, tmp_path):
    import json

    config = json.loads(library.to_str())
    config["model"]["merges"] = config["model"]["merges"][:1000] + config["model"]["merges"][1001:]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(config))
    other = balanced_packing.Encoder(str(path))
    assert other.ranked is None
    assert other.ids("some words of it").tolist() == tokenizers.Tokenizer.from_file(str(path)).encode("some words of it", add_special_tokens=False).ids


def test_words_and_parts_give_the_library_s_ids(library, monkeypatch):
    monkeypatch.setattr(balanced_packing, "CHUNK", 40)
    encode = balanced_packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    draw = random.Random(2)
    for alphabet in ("ab c'stdéß 12\n\t  .,;", "ab  \n<|endoftext|>中\x1c²ⅷ\U0001f600", "don't we'll I'M 3rd ½ “q” naïve"):
        for _ in range(300):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(300)))
            assert encode.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_plain_characters_have_the_classes_of_unicode():
    import re

    import regex

    for c in map(chr, range(0x3000)):
        if balanced_packing.PLAIN.fullmatch(c):
            classes = [bool(regex.fullmatch(p, c)) for p in (r"\p{L}", r"\p{N}", r"\s")]
            sets = (balanced_packing.LETTERS, balanced_packing.DIGITS, balanced_packing.BLANKS)
            assert classes == [bool(re.fullmatch(f"[{s}]", c)) for s in sets], hex(ord(c))


def test_assignment_goes_to_the_lowest_cost_with_room():
    pieces, costs = balanced_packing.assign([60, 50, 40, 30, 20, 56], size=128, width=1)
    assert pieces == [(0, 0, 60, 0, 0), (5, 0, 56, 1, 0), (1, 0, 50, 1, 56), (2, 0, 40, 0, 60), (3, 0, 28, 0, 100), (4, 0, 20, 1, 106), (3, 28, 2, 1, 126)]
    assert len(costs) == 2
    draw = random.Random(4)
    for _ in range(50):
        lengths = [draw.randrange(1, 200) for _ in range(draw.randrange(1, 80))]
        pieces, costs = balanced_packing.assign(lengths, size=128)
        sizes = balanced_packing.room(sum(lengths), 128)
        held = np.bincount([p[3] for p in pieces], weights=[p[2] for p in pieces], minlength=len(costs))
        assert held.tolist() == sizes.tolist() and sum(sizes) == sum(lengths)


def test_costs_are_balanced(spark):
    """Sequences of many short documents cost alike."""
    draw = random.Random(5)
    lengths = [draw.randrange(5, 400) for _ in range(4000)]
    full = np.flatnonzero(balanced_packing.room(sum(lengths)) == 2048)
    _, costs = balanced_packing.assign(lengths)
    in_order, at = np.zeros(len(full) + 12), 0
    for n in lengths:  # laid end to end
        in_order[at // 2048] += balanced_packing.cost(n)
        at += n
    assert np.std(costs[full]) < 0.25 * np.std(in_order[: len(full)])

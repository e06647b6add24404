"""Hard negatives against all pairs in plain Python."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from codetrials.llm import hard_negatives, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<float>, label int, id long, score long, anchor long, block string"


def brute(rows, every=100, positives=5, negatives=10, lower=30, upper=90):
    kept = [
        (i, label, [math.floor(256 * float(x)) for x in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, (a, own, va) in enumerate(kept):
        if a % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(va, v)), i, label) for k, (i, label, v) in enumerate(kept) if k != n)
        for p, best, _ in [s for s in scored if s[2] == own][:positives]:
            window = [s for s in scored if s[2] != own and lower * -p <= 100 * -s[0] <= upper * -p][:negatives]
            out += [(a, best, k + 1, i, -p, -x) for k, (x, i, _) in enumerate(window)]
    return sorted(out)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in df.collect())


def test_whole_query(spark):
    rows = [(r.vec_id, r.embedding, r.label if r.label is None or r.vec_id % 7 else (r.label + 1) % 10) for r in queries.table(spark, SMALL, "embeddings").collect()]
    assert got(queries.op13_slot_negatives(spark, SMALL)) == brute(rows) != []


@pytest.fixture(scope="module")
def hard():
    """Ties, common vectors, one label with most rows, zero, negative and broken vectors, repeated rows, other lengths."""
    draw = random.Random(11)
    vector = lambda: [draw.choice([-0.5, -0.1, 0.0, 0.25, 0.5, 1.0]) for _ in range(4)]
    common = [0.5, 0.25, 1.0, 0.5]
    rows = [(k, common if draw.random() < 0.3 else vector(), 1 if draw.random() < 0.5 else draw.randrange(4)) for k in range(-300, 900)]
    rows += [(1000, [0.0] * 4, 1), (1100, [-9.0] * 4, 2), (1200, [], 0), (1300, [0.5, 1.0], 1), (1400, [0.5] * 6, 2)]
    rows += [(1500, None, 1), (1600, common, None), (1700, [math.nan, 1.0, 1.0, 1.0], 1), (1800, [math.inf, 1.0, 1.0, 1.0], 1), (1900, [None, 1.0, 1.0, 1.0], 1)]
    rows += [(100, common, 1), (100, common, 1), (205, vector(), 2), (205, vector(), 3), (None, common, 1), (2000, common, 77)]
    draw.shuffle(rows)
    return rows


def test_hard_cases(spark, hard, monkeypatch):
    queries.known_to_workers(spark)
    df = spark.createDataFrame([(*r, 1, 2, 3, "b") for r in hard], SCHEMA).repartition(3)
    want = brute(hard)
    assert got(hard_negatives.mine(df)) == want and len(want) > 100
    for name, small in (("GROUP_ANCHORS", 5), ("GROUP_ROWS", 100)):  # many cells
        monkeypatch.setattr(hard_negatives, name, small)
    assert got(hard_negatives.mine(df)) == want
    assert got(hard_negatives.mine(df, every=50, positives=3, negatives=4, lower=10, upper=70)) == brute(hard, 50, 3, 4, 10, 70)
    assert got(hard_negatives.mine(df.limit(0))) == []
    assert got(hard_negatives.mine(df.where("vec_id % 100 <> 0"))) == []


def test_scores_are_exact():
    draw = np.random.Generator(np.random.PCG64(3))
    a, b = (draw.integers(-(1 << 26), 1 << 26, (5, 8)) for _ in range(2))
    assert hard_negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
    with pytest.raises(ValueError):
        hard_negatives.products(a << 20, b << 20)
    with pytest.raises(ValueError):
        hard_negatives.whole_numbers(np.array([[1e300]]))


def test_combiners_keep_the_best_of_each_key():
    draw = np.random.Generator(np.random.PCG64(4))
    rows = np.stack([draw.integers(0, 5, 400), draw.integers(1, 4, 400), draw.integers(0, 50, 400), draw.integers(0, 9, 400)])
    want = []
    for key in sorted({(a, s) for a, s in rows[:2].T.tolist()}):
        own = sorted((-x, i) for a, s, i, x in rows.T.tolist() if (a, s) == key)[:3]
        want += [(*key, i, -x) for x, i in own]
    assert [tuple(x) for x in hard_negatives.combined(rows, 3).T.tolist()] == want

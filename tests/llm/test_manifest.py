"""The manifest against hashes computed row by row."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from codetrials.llm import dataset_manifest, queries

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf string, hash string, grp string, place int, steps string"
LOWER = {c: c + 32 for c in range(65, 91)}


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def first(v):
    return (v is not None, v.encode() if isinstance(v, str) else v or 0)


def tree(nodes, fanout):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + fanout]) for k in range(0, len(levels[-1]), fanout)])
    return levels


def steps(levels, i, fanout):
    out = []
    for level in levels[:-1]:
        run, at = level[i // fanout * fanout :][:fanout], i % fanout
        out.append((run[:at], run[at + 1 :]))
        i //= fanout
    return out


def brute(docs, fanout=16, every=5):
    by = {}
    for r in docs:
        by.setdefault(r[1], []).append((r[0], H(*map(field, r)), r))
    trees = {}
    for k, v in by.items():
        v.sort(key=lambda x: (first(x[0]), x[1]))
        trees[k] = tree([x[1] for x in v], fanout)
    names = sorted(by, key=first)
    top = tree([trees[k][-1][0] for k in names], fanout) if by else []
    out = []
    for n, k in enumerate(names):
        for i, (d, leaf, r) in enumerate(by[k]):
            path, node = steps(trees[k], i, fanout) + steps(top, n, fanout), leaf
            if d is not None and zlib.crc32(str(d).encode()) % every == 0:
                node = H(*map(field, (*r[:4], r[4] and r[4].translate(LOWER))))
            for a, b in path:
                node = H(*a, node, *b)
            out.append((d, leaf, trees[k][-1][0], top[-1][0], H(*[x for a, b in path for x in (*a, *b)]), node, node == top[-1][0]))
    return sorted(out, key=repr)


def rows_of(df):
    return [(r.doc_id, r.source, r.lang, r.n_chars, r.text) for r in df.collect()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def hard(spark):
    """Null fields, null and repeated ids, equal rows, sources of one row, of null and of awkward names."""
    draw = random.Random(3)
    names = [None, "", "=", "é", "\U0001f600", "~", "A"] + [f"s{k}" for k in range(30)]
    rows = [(draw.randrange(-50, 5000), draw.choice(names[:4]) if draw.random() < 0.6 else draw.choice(names), draw.choice(["en", None]), draw.randrange(9), draw.choice(["Ab É", "", None, "xyz"])) for _ in range(1200)]
    rows += [(None, "big", None, None, None)] * 20 + [(7, "big", "en", 1, "ABC")] * 40 + [(k, "big", "en", k, f"T{k}") for k in range(300)] + [(1, "alone", "de", 2, "A" * 50_000)]
    draw.shuffle(rows)
    return spark.createDataFrame([(*r, "x", "y", "z", 1, "w") for r in rows], SCHEMA).repartition(3)


def test_every_row_of_hard_cases(spark):
    docs = hard(spark)
    assert got(dataset_manifest.audited(docs)) == brute(rows_of(docs))


def test_whole_query(spark):
    docs = queries.table(spark, SMALL, "documents")
    found = queries.op11_slot_manifest(spark, SMALL)
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got(found) == brute(rows_of(docs))


@pytest.mark.parametrize("n", [1, 15, 16, 17, 256, 257])
def test_runs_that_are_not_full(spark, n):
    docs = spark.createDataFrame([(k, "one", "en", 1, f"T {k}") for k in range(n)], "doc_id long, source string, lang string, n_chars long, text string")
    assert got(dataset_manifest.audited(docs)) == brute(rows_of(docs))


def test_empty_table_and_other_fanout(spark):
    docs = spark.createDataFrame([(k, f"s{k % 7}", None, k, "T") for k in range(100)], "doc_id long, source string, lang string, n_chars long, text string")
    assert dataset_manifest.audited(docs.limit(0)).count() == 0
    made = dataset_manifest.Manifest(docs, fanout=3)
    assert {(r[0], r[2], r[3], r[4]) for r in made.verified().collect()} == {(r[0], r[2], r[3], r[4]) for r in brute(rows_of(docs), 3)}
    assert made.verified().where("not verified").count() == 0
    assert {r.source for r in made.subroots().collect()} == {f"s{k}" for k in range(7)}


def test_claims_that_are_wrong_are_found(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(k, f"s{k % 3}", None, k, "T") for k in range(60)], "doc_id long, source string, lang string, n_chars long, text string")
    made = dataset_manifest.Manifest(docs, claimed={"n_chars": F.when(F.col("doc_id") == 17, 18).otherwise(F.col("n_chars"))})
    assert [r.doc_id for r in made.verified().where("not verified").collect()] == [17]

from __future__ import annotations

import random

import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from codetrials.operators import ranges


def brute(values, table):
    return sorted(((v, n) for v in values if v is not None for n, a, z in table if a is not None and z is not None and a <= v <= z), key=repr)


def cases():
    draw = random.Random(8)
    table = [(f"r{k}", a, a + draw.choice([0, 1, 2, 3, 7, 8, 100, 5000])) for k in range(300) for a in [draw.randrange(-3000, 3000)]]
    table += [("empty", 5, 4), ("open", None, 4), ("huge", -(1 << 61), 1 << 60), ("point", 7, 7), ("twice", 0, 9), ("twice", 5, 20)]
    values = [draw.randrange(-4000, 9000) for _ in range(400)] + [7] * 50 + [None, -(1 << 61), 1 << 60, (1 << 60) + 1]
    return values, table


def test_every_range_that_holds_a_value(spark):
    values, table = cases()
    rows_ = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v long, n long").repartition(3)
    cohorts = spark.createDataFrame(table, "cohort string, low long, high long")
    found = ranges.matching_ranges(rows_, cohorts, "v")
    assert rows(found.select("v", "cohort")) == brute(set(values), table)
    assigned = ranges.assign_ranges(rows_, cohorts, "v")
    by_value = {}
    for v, n in brute(set(values), table):
        by_value.setdefault(v, []).append(n)
    want = [(v, k, n) for k, v in enumerate(values) for n in by_value.get(v, [None])]
    assert rows(assigned) == sorted(want, key=repr)


def test_stats_count_a_result_once_a_cohort(spark):
    values, table = cases()
    draw = random.Random(1)
    results = [(v, draw.choice(["PASSED", "FAILED", "FAILED_TO_RUN", None])) for v in values]
    got = ranges.range_stats(spark.createDataFrame(results, "v long, status string"), spark.createDataFrame(table, "cohort string, low long, high long"), "v")
    held = {}
    for n, a, z in table:
        for k, (v, _) in enumerate(results):
            if None not in (v, a, z) and a <= v <= z:
                held.setdefault(n, set()).add(k)
    for r in got.collect():
        own = [results[k][1] for k in held.get(r.cohort, ())]
        assert (r.total, r.passed, r.failed) == (len(own), own.count("PASSED"), own.count("FAILED") + own.count("FAILED_TO_RUN"))
    assert got.count() == len({n for n, _, _ in table})


def test_very_many_ranges_without_a_nested_loop(spark):
    n = F.col("id")
    table = spark.range(100_000).select(F.concat(F.lit("c"), n).alias("cohort"), (n * 3).alias("low"), (n * 3 + n % 50).alias("high"))
    points = spark.range(0, 300_000, 1, 4).select(n.alias("v"))
    found = ranges.matching_ranges(points, table, "v")
    text = plan(found)
    assert "NestedLoop" not in text and "Cartesian" not in text
    want = sum(min(3 * k + k % 50, 299_999) - 3 * k + 1 for k in range(100_000) if 3 * k < 300_000)
    assert found.count() == want


def test_no_ranges_and_too_wide_ones(spark):
    points = spark.createDataFrame([(1, "PASSED")], "v long, status string")
    none = spark.createDataFrame([], "cohort string, low long, high long")
    assert ranges.matching_ranges(points, none, "v").collect() == []
    assert rows(ranges.assign_ranges(points, none, "v")) == [(1, "PASSED", None)]
    with pytest.raises(ValueError):
        ranges.matching_ranges(points, spark.createDataFrame([("x", -(1 << 62), 1 << 61)], none.schema), "v")

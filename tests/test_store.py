from __future__ import annotations

import random

from conftest import plan, rows
from pyspark.sql import functions as F

from codetrials.operators import coverage, layout, verdicts
from codetrials.sources import store


def test_bucketed_tables_meet_without_an_exchange(spark, tmp_path):
    before = {t.name for t in spark.catalog.listTables()}
    n = F.col("id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        impls = spark.range(500).select(
            (n % 50).alias("task_id"), F.lit("Java").alias("language"), n.cast("string").alias("impl"), F.lit("p").alias("path"), F.lit("c").alias("content")
        )
        suites = spark.range(40).select(n.alias("task_id"), F.lit("Java").alias("language"), F.lit("t").alias("path"), F.lit("s").alias("content"))
        keys = ["task_id", "language"]
        kept = [store.bucketed(t, str(tmp_path / name), keys, 8) for name, t in (("i", impls), ("s", suites))]
        pairs = layout.fan_out(*kept)
        assert "Exchange" not in plan(pairs) and "SortMergeJoin" in plan(pairs)
        assert rows(pairs) == rows(layout.fan_out(impls, suites))

        judged = spark.range(300).select(
            (n % 50).alias("task_id"), F.when(n % 2 == 0, "ir").otherwise("incs").alias("variant"), n.alias("run_id"), F.lit("PASS").alias("status"), F.lit("o").alias("output")
        )
        tasks = spark.range(60).select(n.alias("task_id"), F.lit("p").alias("prompt"))
        kept = [store.bucketed(t, str(tmp_path / name), ["task_id"], 8) for name, t in (("t", tasks), ("v", judged))]
        attached = verdicts.attach_verdicts(*kept, order="run_id")
        assert "Exchange" not in plan(attached)
        assert rows(attached) == rows(verdicts.attach_verdicts(tasks, judged, order="run_id"))

        results = spark.range(200).select((n % 70).alias("task_id"), F.when(n % 3 == 0, "PASSED").otherwise("FAILED").alias("status"), n.alias("run_id"))
        totals = spark.range(60).select(n.alias("task_id"), n.alias("total_lines"))
        kept = [store.bucketed(t, str(tmp_path / name), ["task_id"], 8) for name, t in (("r", results), ("c", totals))]
        covered = coverage.attach_coverage(*kept, keys=["task_id"])
        assert "Exchange" not in plan(covered)
        assert rows(covered) == rows(coverage.attach_coverage(results, totals, keys=["task_id"]))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {t.name for t in spark.catalog.listTables()} == before


def test_a_batch_is_there_once_and_whole(spark, tmp_path):
    logs = spark.createDataFrame([("A_tests", "l1"), ("B_tests", "l2")], "target string, line string")
    log = store.BatchLog(spark, str(tmp_path / "log"))
    schema = "target string, line string"
    for name in ("one", "two", "one"):
        log.append(logs, name)
    log.write(logs, "half")
    got = store.BatchLog(spark, str(tmp_path / "log")).read(schema)
    assert rows(got.select("batch", "target", "line")) == [(b, *r) for b in ("one", "two") for r in rows(logs)]
    log.append(logs.where("target = 'A_tests'"), "two")
    assert log.read(schema).where("batch = 'two'").count() == 1
    log.append(logs, "half")
    assert log.read(schema).count() == 5


def test_merges_touch_their_buckets_only(spark, tmp_path):
    draw = random.Random(2)
    table = store.NewestTable(spark, str(tmp_path / "newest"), ["k"], ["seq"], buckets=8)
    schema = "k long, seq long, v string"
    newest = {}
    batches = []
    for b in range(5):
        rows_ = [(draw.randrange(40), 100 * b + s if b != 3 else s, f"{b}-{s}") for s in range(3 if b == 4 else 30)]
        batches.append(rows_)
        touched = table.merge(spark.createDataFrame(rows_, schema), f"b{b}")
        for k, s, v in rows_:
            if k not in newest or newest[k][0] < s:
                newest[k] = (s, v)
        assert rows(table.read(spark.createDataFrame([], schema).schema)) == sorted(((k, *x) for k, x in newest.items()), key=repr), b
    assert len(touched) <= 3
    folders = sorted(p.name for p in (tmp_path / "newest/data/batch=b4").iterdir() if p.is_dir())
    assert folders == sorted(f"bucket={b}" for b in touched)
    assert table.merge(spark.createDataFrame(batches[4], schema), "b4") == touched
    assert rows(table.read(spark.createDataFrame([], schema).schema)) == sorted(((k, *x) for k, x in newest.items()), key=repr)
    assert table.merge(spark.createDataFrame([], schema), "none") == []

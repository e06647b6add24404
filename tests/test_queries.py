"""Every named query against its SQL on the given tables, and the shape of the plans."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest
from conftest import SMALL, plan

import __spark_entry__ as contract
from codetrials.plans import derived
from codetrials.plans.oracle import all_oracles
from codetrials.plans.queries import all_queries

QUERIES, ORACLES = all_queries(), all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def canonical(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(
        (tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)),
        key=lambda row: tuple((v is None, str(v)) for v in row),
    )


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SMALL).toPandas()
    want = duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["cohort", "total", "passed", "failed", "pass_pct", "fail_pct"]
    assert df.count() == 2


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_plans_have_no_cross_join_and_no_broadcast_hint(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize(
    "name",
    ["notebook_fields_nested", "notebook_records_nested", "notebook_scan", "exported_functions_text", "add_exports", "remove_main", "text_dedent",
     "verdict_interpreted", "verdict_gradle", "assign_cohort", "case_results", "report_text", "report_lines", "impl_scan_java", "folder_scan_java",
     "notebook_quarantine"],
)
def test_row_local_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SMALL))


def test_no_query_uses_python_functions(spark):
    for name, query in QUERIES.items():
        text = plan(query(spark, SMALL))
        assert not any(x in text for x in ("EvalPython", "MapInArrow", "MapInPandas", "FlatMapGroups", "ExistingRDD")), name
        assert "task_folders" not in text or name.startswith("folder_scan"), name


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(QUERIES["jacoco_totals"](spark, SMALL))
    assert "l_shipdate" not in text and "l_tax" not in text
    assert "partial_sum" in text and "HashAggregate" in text
    text = plan(QUERIES["decode_tests"](spark, SMALL))
    assert "EqualTo(role,user)" in text


def test_newest_is_limited_before_the_shuffle(spark):
    text = plan(QUERIES["latest_result"](spark, SMALL))
    assert text.count("WindowGroupLimit") == 2 and "Partial" in text


def test_carry_over_combines_before_the_shuffle(spark):
    for name in ("notebook_fields", "exported_functions"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "partial_" in text and "SortAggregate" not in text, name


def test_hot_key_join_is_split(spark):
    """One task with most of the implementations: the adaptive skew join cuts its partition."""
    from pyspark.sql import functions as F

    from codetrials.operators.layout import fan_out

    changed = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100KB",
    }
    before = {k: spark.conf.get(k, None) for k in changed}
    for k, v in changed.items():
        spark.conf.set(k, v)
    try:
        n = F.col("id")
        impls = spark.range(0, 60000, 1, 8).select(
            F.when(n % 3 == 0, 0).otherwise(n).alias("task_id"), F.lit("Java").alias("language"),
            n.cast("string").alias("impl"), F.lit("p").alias("path"), F.sha2(n.cast("string"), 512).alias("content"),
        )
        suites = spark.range(0, 60000, 1, 8).select(
            n.alias("task_id"), F.lit("Java").alias("language"), F.lit("t").alias("path"), F.lit("c").alias("content")
        )
        pairs = fan_out(impls, suites)
        assert len(pairs.collect()) == 60000
        assert "skew=true" in plan(pairs)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_derived_tables_follow_their_source(spark):
    events = derived.table(spark, SMALL, "events").count()
    assert derived.runs(spark, SMALL).count() == 2 * events
    assert derived.jest(spark, SMALL).count() == events


def test_scratch_tables_go_to_the_shared_folder(spark):
    from codetrials.plans.scratch import scratch_path

    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first.startswith(f"{shared}/") and first != second

"""Plan shape checks: the physical strategies the design relies on."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from conftest import SF_SMALL


def plan(spark, name):
    df = entry.queries()[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString() + df._jdf.queryExecution().optimizedPlan().toString()


def test_topk_per_group_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in plan(spark, "papers_topk_per_category")


@pytest.mark.parametrize("name", ["bulletin_top3", "trending_topk"])
def test_topn_is_take_ordered(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_config_is_broadcast(spark):
    p = plan(spark, "important_items")
    assert "broadcast" in p.lower()


@pytest.mark.parametrize("name", ["bulletin_ranked", "eval_state", "score_items", "validate_responses",
                                  "upsert_merge", "first_summary"])
def test_no_python_in_builtin_queries(spark, name):
    p = plan(spark, name)
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "PythonUDF"):
        assert node not in p


def test_rich_text_uses_arrow_udf(spark):
    assert "ArrowEvalPython" in plan(spark, "flatten_rich_text")


def test_text_not_read_when_not_needed(spark):
    df = entry.queries()["projects_recent"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "o_totalprice" not in p.split("ReadSchema")[-1].split("\n")[0]


def test_filters_reach_the_scan(spark):
    df = entry.queries()["projects_recent"](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in p


def test_store_queries_do_not_shuffle_input_json(spark):
    # the heavy JSON input (whole texts) is pruned away from queries that do not use it
    p = plan(spark, "eval_state")
    assert "to_json" not in p and "StructsToJson" not in p


def test_recency_prefilter_reaches_the_scan(spark):
    from gleaner.operators import bulletin
    from gleaner.plans import bindings as b
    from gleaner.session import scratch_path
    from gleaner.sources import store
    path = store.save_snapshot(b.store(spark, SF_SMALL), scratch_path(spark, "plan-store"))
    df = bulletin.bulletin_items(spark.read.parquet(path), b.BINDING_CONFIG, b.AS_OF)
    p = df._jdf.queryExecution().executedPlan().toString()
    pushed = [line for line in p.split("\n") if "PushedFilters" in line]
    assert any("creation_date" in line for line in pushed)


def test_upsert_joins_narrow_and_never_full_outer(spark):
    from datetime import datetime

    from gleaner.operators import collect
    from gleaner.plans import bindings as b
    items = b.items(spark, SF_SMALL).withColumn("first_collected", F.lit(datetime(2024, 1, 1))) \
        .withColumn("last_collected", F.lit(datetime(2024, 1, 1)))
    batch = items.where(F.col("ord") < 10).select(*b.items(spark, SF_SMALL).columns)
    merged = collect.upsert_merge(items, batch, datetime(2024, 1, 31))
    p = merged._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in p and "LeftOuter" in p and "FullOuter" not in p


@pytest.mark.parametrize("name,scans", [("eval_state", 0), ("dedup_first_wins", 0), ("upsert_merge", 0), ("collect_counts", 0),
                                        ("score_items", 1)])
def test_texts_are_scanned_once_besides_the_key_table(spark, name, scans):
    """The key table's own scan is its checkpoint; the plan reads the texts at most once more."""
    df = entry.queries()[name](spark, SF_SMALL)
    p = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert p.count("documents.parquet") <= scans

"""What the physical plans of all queries must not hold, with broadcasting switched off."""

import os

import pytest

import __spark_entry__ as entry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = entry.queries()


@pytest.fixture(scope="module")
def planner(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.enabled": "false",
        "spark.sql.maxMetadataStringLength": "10000",
        "spark.sql.debug.maxToStringFields": "1000",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield lambda name: QUERIES[name](spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    for key in settings:
        spark.conf.unset(key)


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cross_joins_and_no_row_functions(planner, name):
    plan = planner(name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert operator not in plan


def test_only_needed_columns_are_read(planner):
    plan = planner("exec_metrics")
    assert "ReadSchema: struct<l_orderkey:bigint,l_returnflag:string,l_linestatus:string>" in plan
    assert "l_extendedprice" not in plan


def test_filters_reach_the_scan(planner):
    plan = planner("log_query")
    assert "EqualTo(event_type,error)" in plan and "GreaterThanOrEqual(ts" in plan and "StringContains(props,7)" in plan


def test_days_out_of_range_are_not_read(planner):
    assert "PartitionFilters: [isnotnull(day" in planner("dlq_retention")


def test_top_k_is_cut_in_every_task(planner):
    for name in ("pending_topk", "dashboard_recent", "exec_page", "log_retain_last", "dlq_list"):
        assert "TakeOrderedAndProject" in planner(name)


def test_rows_of_a_window_are_shuffled_once(planner):
    plan = planner("version_next")
    rows = plan.split("SortMergeJoin [__key")[1].split("Window [sum")[0]
    assert rows.count("FileScan") == 1 and rows.count("Exchange hashpartitioning(__key") == 2


def test_texts_stay_where_they_are_read(planner):
    for name in ("validate_rules", "dq_verdict", "validate_all", "validation_merge"):
        above_join = planner(name).split("SortMergeJoin")[0]
        assert "text#" not in above_join.replace("text_errors", "")

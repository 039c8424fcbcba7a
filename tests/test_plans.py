"""Plans of the registered queries: no pairwise joins, no Python rows, pruned scans."""

import re

import pytest

import __spark_entry__ as entry

SF_DIR = "/root/testdata/sf0.001"
QUERIES = {n: q for n, q in entry.queries().items() if q.__module__.startswith("loadlens.catalog")}
BATCH = [name for name in QUERIES if not name.startswith("stream_")]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for word in ("CartesianProduct", "NestedLoopJoin", "EvalPython", "InPandas", "FlatMapGroups"):
        assert word not in text


def test_capacity_reads_four_columns_and_shuffles_twice(spark):
    text = plan(QUERIES["user_bins"](spark, SF_DIR))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text).group(1)
    assert sorted(c.split(":")[0] for c in schema.split(",")) == [
        "event_type", "ts", "user_id", "value"]
    assert text.count("Exchange hashpartitioning") == 2


def test_label_filter_is_pushed_down(spark):
    text = plan(QUERIES["run_starts"](spark, SF_DIR))
    assert "Filter" in text and "ReadSchema" in text
    host = plan(QUERIES["telemetry_summary"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,view)]" in host


def test_small_bins_are_broadcast_not_the_metrics(spark):
    text = plan(QUERIES["correlate_host"](spark, SF_DIR))
    assert "BroadcastHashJoin" in text


def test_approximate_split_needs_no_shuffle(spark):
    assert "Exchange" not in plan(QUERIES["split_train_test"](spark, SF_DIR))


def test_top_errors_are_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(QUERIES["report_top_errors"](spark, SF_DIR))

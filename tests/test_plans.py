"""The plans are the ones wanted: no nested loops, pruned columns, pushed filters."""

import re

import pytest

from tessella import kit_queries, queries  # noqa: F401

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_no_nested_loops(spark, name):
    text = plan(queries.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_columns_and_filters_reach_the_scan(spark):
    text = plan(queries.q05_rms_decibels(spark, DATA))
    assert re.findall(r"ReadSchema: struct<([^>]*)>", text) == ["event_type:string,value:double"]
    text = plan(queries.q02_ingest_gate(spark, DATA))
    assert "EqualTo(toxic,0)" in text and "ReadSchema: struct<doc_id:bigint,text:string,source:string>" in text
    text = plan(queries.q32_weighted_score(spark, DATA))
    assert "Exchange" not in text and "l_extendedprice" not in text


def test_aggregates_combine_before_the_shuffle(spark):
    for name in ("q05_rms_decibels", "q14_beat_mean", "q28_isolation", "q45_stage_status"):
        assert "partial_" in plan(queries.QUERIES[name](spark, DATA))

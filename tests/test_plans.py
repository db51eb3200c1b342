"""Plan guards for every registered batch query: no cartesian products and
no nested-loop joins (all joins are equi-joins, OR scopes are rewritten)."""

import pytest

from data_paths import SF001

from revlens.catalog import queries

BATCH = sorted(k for k in queries() if not k.startswith("T"))


@pytest.mark.parametrize("name", BATCH)
def test_no_cartesian_or_nested_loop(spark, name):
    df = queries()[name](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan, name
    assert "BroadcastNestedLoopJoin" not in plan, name


def test_scan_pruning_and_pushdown(spark):
    df = queries()["S09_get_filtered"](spark, SF001)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # the repository filter reaches the documents scan through the left joins
    assert "EqualTo(source,src11)" in plan
    a05 = queries()["A05_repo_breakdown"](spark, SF001)._jdf.queryExecution().executedPlan().toString()
    # documents are read with only the columns the breakdown needs
    assert "ReadSchema: struct<doc_id:bigint,source:string>" in a05

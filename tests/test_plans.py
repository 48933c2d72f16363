"""Plans: no nested loops or cross joins, filters and columns reach the scan."""

import re

import pytest

from chronoloom.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_pairwise_plan(spark, data, name):
    plan = registry.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoopJoin", plan)
    for columns in re.findall(r"FileScan parquet \[([^\]]*)\]", plan):
        assert "received_at" not in columns and "loaded_at" not in columns


def test_filters_reach_the_scan(spark, data):
    plan = registry.queries()["coincidence_semi"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "props" not in plan

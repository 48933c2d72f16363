import re

import pytest

from chronoloom.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_no_pairwise_plan(spark, data, name):
    plan = Q.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|NestedLoopJoin", plan)

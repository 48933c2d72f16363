import pytest

from chronoloom.llm import queries as Q
from tests.compare import same, views


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, data, con, name):
    df = Q.QUERIES[name](spark, data)
    if name in Q.sql():
        same(df, con, Q.sql()[name])
    else:
        assert df.count() > 0


def test_registered():
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries()) and set(Q.sql()) <= set(Q.QUERIES)


def test_mix_reaches_its_targets(spark, data):
    s = [r for r in Q.p8_shares(spark, data).collect()]
    live = sum(r["target_share"] for r in s if r["documents"])
    assert all(r["most_repeats"] <= r["max_repeats"] for r in s)
    assert sum(r["actual_share"] for r in s) == pytest.approx(1.0) and live > 0.5

import pytest

from chronoloom.plans import registry
from tests.compare import same, views

SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return views(data)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, data, con, name):
    df = registry.queries()[name](spark, data)
    if name in SQL:
        same(df, con, SQL[name])
    else:
        assert df.columns and df.count() > 0


def test_every_sql_has_a_query():
    assert set(SQL) <= set(registry.queries())


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "bind_greedy_pairs" in e.queries()

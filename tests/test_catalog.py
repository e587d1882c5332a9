import pytest

from kgloom import catalog
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(name, same):
    same(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_without_sql_runs(name, spark):
    assert catalog.QUERIES[name](spark, SF).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

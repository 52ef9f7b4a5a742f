"""Every registered query against its SQL oracle."""

import pytest
from oracle import connection, rows

from tidemark.catalog_of_queries import QUERIES, SQL
from tidemark.plans.registry import TABLES


@pytest.fixture(scope="module")
def duck(sf):
    return connection(sf, TABLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, duck):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

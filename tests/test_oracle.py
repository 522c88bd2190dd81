"""Every registered query of the core library against its SQL, on the smallest tables."""

import compare
import pytest

from tidewatch.plans import registry

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    assert compare.difference(QUERIES[name](spark, FOLDER), duck, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql(spark, name):
    assert QUERIES[name](spark, FOLDER).columns


def test_sql_names_are_queries():
    assert set(SQL) <= set(QUERIES)

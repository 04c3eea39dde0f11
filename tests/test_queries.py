import pytest

from orelode.plans import ORACLE_SQL, QUERIES

from .oracle import connect, same


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, con):
    same(QUERIES[name](spark, sf_dir), con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_runs(name, spark, sf_dir):
    assert QUERIES[name](spark, sf_dir).count() >= 0

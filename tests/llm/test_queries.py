"""The queries with SQL give the rows of their SQL; the others run and have rows."""

import pytest

from tests.oracle import connect, same
from wavemill.llm import queries as Q


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_same_as_sql(spark, data, con, name):
    same(Q.QUERIES[name](spark, data), con, Q.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(Q.QUERIES) - set(Q.ORACLE) - {n for n in Q.QUERIES if n.startswith("p8_")}))
def test_runs(spark, data, name):
    assert Q.QUERIES[name](spark, data).count() > 0

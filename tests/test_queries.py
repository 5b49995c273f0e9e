"""Every registered query of the core with SQL gives the rows of its SQL."""

import importlib

import pytest

import __spark_entry__ as entry
from tests.oracle import connect, same

MODULES = [importlib.import_module(m) for m in entry.MODULES]
NAMES = sorted(n for m in MODULES for n in m.ORACLE)


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_same_as_sql(spark, data, con, name):
    m = next(m for m in MODULES if name in m.ORACLE)
    same(m.QUERIES[name](spark, data), con, m.ORACLE[name])


def test_entry_has_rows(spark, data):
    assert entry.entry(spark).count() > 0


def test_names_are_unique():
    names = [n for m in MODULES for n in m.QUERIES]
    assert len(names) == len(set(names))

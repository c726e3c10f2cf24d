"""Every registered query against its SQL twin on the smallest tables."""

import pytest
from compare import compare, duck
from conftest import FOLDER

import __spark_entry__ as entry

SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query_equals_its_twin(spark, con, name):
    ok, note, _ = compare(spark, con, name, entry.queries()[name], SQL.get(name), FOLDER)
    assert ok, note


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0

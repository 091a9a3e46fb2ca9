"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.compare import database, differences
from tests.conftest import SF_SMALL

QUERIES, SQL = entry.queries(), entry.oracle_sql()
# The two whole runs are covered by test_experiment.
SLOW = {"main_run", "ablation_run"}


@pytest.fixture(scope="module")
def con():
    return database(SF_SMALL)


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(SQL))
def test_rows_equal_sql(spark, con, name):
    assert differences(QUERIES[name](spark, SF_SMALL), con, SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL) - SLOW))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_SMALL).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every registered query against its SQL in DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck
from tests.conftest import SMALL

# training-data operators have tests of their own
QUERIES = {k: v for k, v in entry.queries().items() if v.__module__.startswith("stepwright.plans")}
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


def test_every_query_has_sql():
    assert set(QUERIES) <= set(ORACLES)


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, con, name):
    assert difference(QUERIES[name](spark, SMALL), con, ORACLES[name]) is None

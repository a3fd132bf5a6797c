"""Every registered query against its DuckDB statement on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests.harness import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
    assert not [n for n, sql in ORACLES.items() if not sql]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, con, name):
    problem, _, _, _ = compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF)
    assert problem is None, problem


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0

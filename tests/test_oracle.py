"""Every registered query against its DuckDB oracle (and the rows-only
queries for a non-empty, stable result) on the smallest test tables."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from oracle_harness import compare, duck

QUERIES = E.queries()
ORACLE = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    problems, n = compare(spark, con, name, QUERIES[name], ORACLE[name], SMALL)
    assert not problems, problems


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_rows_only_query(spark, name):
    df = QUERIES[name](spark, SMALL)
    assert df.count() > 0
    assert df.schema == QUERIES[name](spark, SMALL).schema


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0

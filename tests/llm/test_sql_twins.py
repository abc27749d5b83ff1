"""The queries of this subpackage that SQL can express, against DuckDB."""

import pytest

from conftest import SMALL
from leafcast.checks.compare import compare, duckdb_connection
from leafcast.llm.oracle import ORACLE_SQL
from leafcast.llm.queries import QUERIES


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_sql_twin(spark, key):
    r = compare(spark, SMALL, key, QUERIES[key], ORACLE_SQL[key], duckdb_connection(SMALL))
    assert r["columns_match"] and r["values_match"], r


def test_every_operator_has_one_query():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 14))

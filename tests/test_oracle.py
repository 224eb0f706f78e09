"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as contract
from filetwin.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, SQL = registry.QUERIES, registry.SQL


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{SF_DIR}/{table}.parquet'")
    return connection


def _sorted(rows):
    return sorted(rows, key=lambda row: tuple((value is None, str(value)) for value in row))


def _types(rows, width):
    return [{type(row[i]) for row in rows} for i in range(width)]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    found = QUERIES[name](spark, SF_DIR)
    columns = sorted(found.columns)
    got = _sorted(tuple(row[c] for c in columns) for row in found.collect())
    assert got, "no rows"
    if name not in SQL:
        return
    relation = duck.sql(SQL[name])
    places = [relation.columns.index(c) for c in columns]
    assert sorted(relation.columns) == columns
    wanted = _sorted(tuple(row[i] for i in places) for row in relation.fetchall())
    assert got == wanted
    assert _types(got, len(columns)) == _types(wanted, len(columns))


def test_flagship(spark):
    assert contract.entry(spark).columns == ["hash_value", "size", "n", "files"]


def test_every_query_has_sql_and_is_handed_out():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(contract.queries()) and set(SQL) <= set(contract.oracle_sql())

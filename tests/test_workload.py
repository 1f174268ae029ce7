"""Every registered query against its SQL at the smallest scale."""

import datetime
import decimal

import duckdb
import pytest

import __spark_entry__ as contract

SF_DIR = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
QUERIES, ORACLES = contract.queries(), contract.oracle_sql()


@pytest.fixture(scope="module")
def base():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return None if value is None else str(value)


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in order) for row in rows), key=lambda r: [(v is not None, v or "") for v in r])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, base, name):
    got = QUERIES[name](spark, SF_DIR)
    cursor = base.execute(ORACLES[name])
    columns = [column[0] for column in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert bag(got.columns, got.collect()) == bag(columns, cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_returns_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).collect()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert "Vozidlo_Vin" in contract.entry(spark).columns

"""Every registered query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_points
from reportloom.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return value if value is None else value.isoformat() if hasattr(value, "isoformat") else str(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(row[i]) for i in order) for row in rows), key=repr)


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, database, name):
    df = QUERIES[name](spark, SF)
    found = sorted_rows(df.columns, df.collect())
    result = database.execute(ORACLES[name])
    assert found == sorted_rows([d[0] for d in result.description], result.fetchall())


def test_entry_points(spark):
    assert entry_points.queries().keys() >= QUERIES.keys() == ORACLES.keys()
    assert entry_points.queries().keys() >= entry_points.oracle_sql().keys() >= ORACLES.keys()
    out = entry_points.entry(spark)
    assert out.columns[:2] == ["r_name", "revenue_1995"] and out.count() == 5

"""Every query of the catalog against its SQL on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from graphloom.catalog import load

SF = os.environ.get("CATALOG_SF", "/root/testdata/sf0.001")
QUERIES, ORACLES = load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(([plain(r[k]) for k in order] for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, SF)
    got = found.collect()
    assert found.columns and len(set(found.columns)) == len(found.columns)
    if name not in ORACLES:
        return
    cursor = duck.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    expected = cursor.fetchall()
    assert sorted(columns) == sorted(found.columns)
    assert rows(found.columns, [tuple(r) for r in got]) == rows(columns, expected)

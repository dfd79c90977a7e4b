"""Queries that SQL can express, against that SQL."""

import duckdb
import pytest

from graphloom.llm import queries, sql
from test_operators import SF


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(sql.ORACLES[name])
    columns = [c[0] for c in cursor.description]
    found = queries.queries()[name](spark, SF)
    assert sorted(columns) == sorted(found.columns)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=repr) == sorted(cursor.fetchall(), key=repr)

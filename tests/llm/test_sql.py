"""The operators' queries that SQL can express, against DuckDB."""

from __future__ import annotations

import os

import duckdb
import pytest

from tarnfell.llm import queries

TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query(spark, name):
    got = queries.queries()[name](spark, TABLES)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TABLES}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)

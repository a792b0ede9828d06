"""Every registered query with SQL, against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

from tarnfell.plans import catalog

TABLES = "/root/testdata"
# relaxation needs the fifty nodes that the smallest tables do not have
LARGER = {"mesh_adaptive"}
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="the driver's tables are not here")


def _plain(row):
    return tuple(round(x, 6) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, name):
    sf_dir = f"{TABLES}/sf0.01" if name in LARGER else f"{TABLES}/sf0.001"
    got = catalog.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    con = duckdb.connect()
    for t in ("supplier", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    rows = sorted((_plain(r[c] for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((_plain(r[i] for i in order) for r in want.fetchall()), key=repr)


def test_every_query_has_sql_or_is_known_not_to():
    without = set(catalog.queries()) - set(catalog.oracle_sql())
    assert without == {"oracle_picks", "greedy_picks_intended", "utility_trace", "estimate_centroid", "budget_curve_centroid", "budget_curve_nearest", "mesh_defaults"}

"""Every registered query of the engine's own operators against its SQL in DuckDB."""

import os

import duckdb
import pytest

from vellumine import registered

TABLES = "region nation customer supplier part orders lineitem events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def cell(v):
    if v is None or v != v:
        return None
    return str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([cell(r[i]) for i in order] for r in data), key=str)


@pytest.mark.parametrize("name", sorted(registered.queries()))
def test_query(spark, duck, sf, name):
    df = registered.queries()[name](spark, sf)
    got = df.collect()
    sql = registered.oracle_sql().get(name)
    if sql is None:
        assert df.columns
        return
    want = duck.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert rows(df.columns, got) == rows(columns, want.fetchall())

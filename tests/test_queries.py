"""Every query of the catalogue against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from markweave.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(v):
    if v is None or v != v:
        return None
    return float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else tuple(v) if isinstance(v, list) else v


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = table_of(df.columns, [tuple(r) for r in df.collect()])
    want = duck.execute(SQL[name])
    assert got == table_of([c[0] for c in want.description], want.fetchall())

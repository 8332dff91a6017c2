import os

import duckdb
import pytest

from markweave.llm import queries as Q


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_runs_on_the_smallest_tables(spark, sf, name):
    df = Q.queries()[name](spark, sf)
    rows = df.collect()
    if name in Q.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(sf):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
        want = con.execute(Q.oracle_sql()[name])
        assert df.columns == [c[0] for c in want.description] and sorted(map(tuple, rows)) == sorted(want.fetchall())
    elif name.endswith("_found"):
        assert len(rows) == len(set(map(tuple, rows)))

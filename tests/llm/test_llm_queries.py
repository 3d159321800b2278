"""Registered text queries run on the smallest tables; those with SQL give the same rows in both engines."""

from pathlib import Path

import duckdb
import pytest

from jangbu.llm import queries

DATA = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, name):
    df = queries.queries()[name](spark, str(DATA))
    got = df.collect()
    assert got
    sql = queries.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        for p in DATA.glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        assert sorted(map(tuple, got)) == sorted(con.execute(sql).fetchall())

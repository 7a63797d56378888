"""The queries that SQL can express against their SQL, on the smallest tables."""

import glob
import os

import pytest

from onomast.llm import queries

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    got = queries.queries()[name](spark, DIR)
    names = sorted(got.columns)
    want = c.execute(f"SELECT {', '.join(names)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.select(*names).collect()), key=str) == sorted(want, key=str)

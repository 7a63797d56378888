"""Every name-search query against its SQL, on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry
from onomast import oracles, queries

duckdb = pytest.importorskip("duckdb")
DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="the tables are not here")


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_equals_sql(spark, sql, name):
    got = queries.queries()[name](spark, DIR)
    names = sorted(got.columns)
    want = sql.execute(f"SELECT {', '.join(names)} FROM ({oracles.oracle_sql()[name]})").fetchall()
    clean = lambda rows: sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)
    assert clean(map(tuple, got.select(*names).collect())) == clean(want)


def test_entry(spark):
    assert set(oracles.oracle_sql()) == set(queries.queries())
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())

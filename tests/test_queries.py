"""Every query of the registry against its SQL in DuckDB, on the smallest tables; those without SQL must give stable columns."""

import os

import duckdb
import pytest
from strandloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v):
    if v is None or v != v:
        return "None"
    if isinstance(v, float):
        return repr(round(v, 6))
    return str(v)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, con, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert df.columns and len(set(df.columns)) == len(df.columns)
    if name not in registry.SQL:
        return
    want = con.sql(registry.SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    assert sorted(tuple(map(shown, r)) for r in rows) == sorted(tuple(shown(r[i]) for i in order) for r in want.fetchall())

"""Every query of the library proper against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from framewright.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    rows = sorted(repr(tuple(r[c] for c in names)) for r in got.collect())
    want = duck.execute(catalogue.ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == names
    assert rows == sorted(repr(tuple(r[columns.index(c)] for c in names)) for r in want.fetchall())

"""Every registered query against its SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from sievework.plans import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def plain(v):
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def rows(names, table):
    at = [names.index(n) for n in sorted(names)]
    return sorted((tuple(plain(r[i]) for i in at) for r in table), key=lambda t: tuple((x is None, str(type(x)), str(x)) for x in t))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    got = rows(df.columns, df.collect())
    if name in SQL:
        cur = con.execute(SQL[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns)
        assert got == rows(names, cur.fetchall())

"""Every core query with SQL gives the rows of its SQL on the smallest tables."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from dapple import plans

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return float(f"{v:.6g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = plans.queries()[name](spark, DATA)
    names = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in names) for r in df.collect())
    cur = duck.execute(plans.oracle_sql()[name])
    at = [[d[0] for d in cur.description].index(c) for c in names]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_entry_and_names(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns

"""Every core query against its SQL on the smallest tables, and the contract of the entry file."""

import glob
import math
import os
from collections import Counter

import duckdb
import pytest

from strandline.plans.registry import ORACLE_SQL, QUERIES


def plain(x):
    if x is None:
        return None
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.6g}")
    return x.replace(tzinfo=None).isoformat() if hasattr(x, "isoformat") else x


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = Counter(tuple(map(plain, r)) for r in df.select(*cols).collect())
    if name not in ORACLE_SQL:
        return
    res = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = Counter(tuple(plain(r[i]) for i in at) for r in res.fetchall())
    assert got == want


def test_entry(spark, data):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["stage", "query_id", "id", "score", "rank"]

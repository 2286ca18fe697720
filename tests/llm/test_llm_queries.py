"""Every training-data query runs on the smallest tables and gives its SQL's rows where it has SQL."""

import glob
import math
import os

import duckdb
import pytest

from quillstone.llm import oracle
from quillstone.llm import queries as made


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(made.queries()))
def test_query(spark, sf, name):
    df = made.queries()[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    sql = oracle.oracle_sql().get(name)
    if sql:
        con = duckdb.connect()
        con.execute("set timezone = 'UTC'")
        for f in glob.glob(f"{sf}/*.parquet"):
            con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
        cur = con.execute(sql)
        at = {d[0]: i for i, d in enumerate(cur.description)}
        assert sorted(at) == cols
        assert got == sorted((tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall()), key=repr)

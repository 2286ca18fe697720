"""Every query that has SQL gives the SQL's rows on the smallest tables; the others run."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillstone.plans import ranking, records

NAMES = sorted({**ranking.queries(), **records.queries()})


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    return v


def compare(spark, con, sf, name, made, sql):
    df = made[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in sql:
        cur = con.execute(sql[name])
        at = {d[0]: i for i, d in enumerate(cur.description)}
        assert sorted(at) == cols
        assert got == sorted((tuple(plain(r[at[c]]) for c in cols) for r in cur.fetchall()), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, sf, name):
    compare(spark, con, sf, name, entry.queries(), entry.oracle_sql())


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_records_without_a_shared_token(spark, sf):
    """Every record is scored with every technique, those without a catalogue word too."""
    made, n = entry.queries(), ranking.catalogue(spark, sf).count()
    ids = {r.query_id for r in ranking.merged(spark, sf).select("query_id").collect()}
    top = made["retrieve_fused"](spark, sf).groupBy("query_id").count().collect()
    assert {r.query_id for r in top} == ids and all(r["count"] == min(20, n) for r in top)
    per = made["score_minmax"](spark, sf).groupBy("query_id").count().collect()
    assert {r.query_id for r in per} == ids and all(r["count"] == n for r in per)


def test_whole_grids(spark, sf):
    """The grids of the reference: 7 alphas by 6 lengths, 11 betas."""
    made = entry.queries()
    got = {(float(r.method), r.run) for r in made["alpha_topn_sweep"](spark, sf).collect()}
    assert got == {(a, n) for a in (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0) for n in (5, 10, 15, 20, 30, 50)}
    assert sorted(float(r.method) for r in made["beta_sweep"](spark, sf).collect()) == [x / 10 for x in range(11)]

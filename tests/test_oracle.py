"""Each query that has SQL gives the SQL's rows on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from lexweave.plans.queries import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return c


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    want = duck.execute(ORACLE[name])
    at = [[d[0] for d in want.description].index(c) for c in cols]
    assert got == sorted((tuple(norm(r[k]) for k in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0

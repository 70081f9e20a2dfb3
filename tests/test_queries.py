"""Every query against its SQL on the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from cadenza.queries import oracle_sql, queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query(spark, duck, name):
    df = queries()[name](spark, SF)
    names = sorted(df.columns)
    got = sorted(tuple(map(cell, r)) for r in df.select(*names).collect())
    result = duck.execute(oracle_sql()[name])
    order = [[d[0] for d in result.description].index(n) for n in names]
    assert len(order) == len(result.description)
    want = sorted(tuple(cell(r[i]) for i in order) for r in result.fetchall())
    assert got == want

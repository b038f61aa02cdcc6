"""Each query against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from idloom.plans import inputs, oracle
from idloom.plans.queries import QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in inputs.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    got = sorted((tuple(_value(r[c]) for c in cols) for r in df.collect()), key=repr)
    cur = duck.execute(oracle.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(_value(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want and got

"""Every query with SQL against DuckDB on the smallest tables; every other one runs."""

import math

import duckdb
import pytest

from sparkshelf.plans import queries as own

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(v):
    if type(v).__name__ == "Decimal":
        v = float(v)
    return round(v, 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", list(own.QUERIES))
def test_query(spark, sf, duck, name):
    df = own.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name in own.SQL:
        got = duck.sql(own.SQL[name])
        at = [got.columns.index(c) for c in columns]
        assert len(at) == len(got.columns)
        assert rows == sorted((tuple(plain(r[i]) for i in at) for r in got.fetchall()), key=repr)

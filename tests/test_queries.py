"""Every registered query with SQL gives DuckDB's rows."""

import glob
import math
import os

import duckdb
import pytest

from chirpline.plans import catalog

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return float(v) if type(v).__name__ == "Decimal" else v


def close(a, b):
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return abs(a - b) <= 1e-6 * max(1.0, abs(a))
    return a == b


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, db, name):
    df = catalog.queries()[name](spark, DATA)
    cur = db.execute(catalog.oracle_sql()[name])
    cols = [x[0] for x in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = [cols.index(c) for c in df.columns]
    key = lambda r: tuple((x is None, str(x) if isinstance(x, str) else "", x if isinstance(x, (int, float)) else 0) for x in r)
    want = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=key)
    got = sorted((tuple(map(norm, r)) for r in df.collect()), key=key)
    assert len(got) == len(want) and all(all(map(close, a, b)) for a, b in zip(got, want))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

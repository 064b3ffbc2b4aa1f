"""Every query with SQL against DuckDB over the smallest tables."""

import math
import os

import pandas as pd
import pytest

from heddle import core_queries as C

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c


def norm(v):
    if v is None or pd.isna(v):
        return ""
    if isinstance(v, (bool, str)):
        return str(v)
    try:
        f = float(v)
        return "" if math.isnan(f) else f"{f + 0.0:.8g}"
    except (TypeError, ValueError):
        return str(v)


@pytest.mark.parametrize("name", sorted(C.ORACLES))
def test_same_as_sql(spark, sf, db, name):
    got, want = C.QUERIES[name](spark, sf).toPandas(), db.sql(C.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda x: sorted(tuple(map(norm, r)) for r in x[cols].itertuples(index=False, name=None))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(C.QUERIES) - set(C.ORACLES)))
def test_runs(spark, sf, name):
    assert C.QUERIES[name](spark, sf).count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

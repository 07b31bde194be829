"""Every named query against its DuckDB statement on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from fieldquarry import queries as domain

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if hasattr(v, "year"):
        return str(pd.Timestamp(v))
    try:
        return f"{float(v):.6f}" if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    cols = sorted(df.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(domain.ORACLES))
def test_query(spark, duck, name):
    assert rows(domain.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(domain.ORACLES[name]).fetchdf())


def test_flagship(spark):
    assert domain.flagship(spark, SF).count() > 0

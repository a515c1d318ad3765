"""Every query with SQL gives the rows that DuckDB gives."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from riskengine.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{small}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and np.isnan(v)):
        return None
    if isinstance(v, (float, np.floating)):
        return f"{v:.9g}"
    if isinstance(v, (int, np.integer, bool, np.bool_)):
        return str(int(v))
    return str(v)[:10] if isinstance(v, pd.Timestamp) else str(v)


def rows(df, names):
    return sorted(tuple(str(plain(x)) for x in r) for r in df[names].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(spark, duck, small, name):
    ours, theirs = catalog.QUERIES[name](spark, small).toPandas(), duck.execute(catalog.ORACLES[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    names = sorted(ours.columns)
    assert rows(ours, names) == rows(theirs, names)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, small, name):
    assert catalog.QUERIES[name](spark, small).count() > 0

"""Every registered query against its SQL in DuckDB, on the smallest tables; and what its plan must not have."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd
import pytest

from trellis import catalog

TABLES = os.environ.get("TRELLIS_TABLES", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{TABLES}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or (not isinstance(v, (list, tuple)) and pd.isna(v)):
        return None
    if isinstance(v, (bool, str)):
        return v
    return float(v) if hasattr(v, "__float__") else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted((tuple(map(plain, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, con, name):
    df = catalog.QUERIES[name](spark, TABLES)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("EvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups", "CartesianProduct"))
    got = df.toPandas()
    if name in catalog.ORACLE:
        want = con.sql(catalog.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

"""Every query with SQL gives the same rows in Spark and in DuckDB; the others give rows."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from regimelab import catalog

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


def plain(df):
    def value(v):
        if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return str(v)[:19].replace(" 00:00:00", "") if hasattr(v, "isoformat") else v

    rows = [tuple(value(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(rows, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, FOLDER).toPandas(), duck.execute(catalog.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=2e-6) for p, q in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_rows(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).limit(3).count() > 0

"""Every query that has SQL against DuckDB on the smallest tables; every other one must give rows of a stable schema."""

import math
import os
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest

import __spark_entry__ as entry

TABLES = Path(os.environ.get("HELIOVOX_TABLES", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in TABLES.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def canonical(df):
    def plain(v):
        if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, (bool, np.bool_)):
            return str(bool(v))
        return f"{float(v) + 0.0:.9g}" if isinstance(v, (int, float, np.number)) else str(v)

    return sorted(tuple(plain(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_against_sql(spark, db, name):
    got, expected = entry.queries()[name](spark, str(TABLES)).toPandas(), db.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert canonical(got) == canonical(expected)


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_runs(spark, name):
    df = entry.queries()[name](spark, str(TABLES))
    assert len(df.collect()) >= 0 and df.columns
    if name.endswith("_found"):
        assert df.count() == df.distinct().count()


def test_entry(spark):
    assert entry.entry(spark).count() > 0

"""Every general query with SQL gives the same rows as DuckDB on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

from difflode import queries as core

DATA = "/root/testdata/sf0.001"
SQL = core.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return c


def rows(df):
    def plain(x):
        if x is None or x is pd.NaT or (isinstance(x, float) and math.isnan(x)):
            return None
        x = x.item() if hasattr(x, "item") else x
        return float(x) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    out = [tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)]
    return sorted(out, key=lambda r: tuple((v is None, isinstance(v, str), str(round(v, 3)) if isinstance(v, float) else str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, con, name):
    got, want = core.queries()[name](spark, DATA).toPandas(), con.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == pytest.approx(v, abs=2e-5) if isinstance(u, float) and isinstance(v, float) else u == v


def test_every_query_has_sql_or_is_known_not_to():
    assert set(core.queries()) - set(SQL) <= {"score_centres", "bootstrap_precision", "matched_accuracy", "split_packing", "unit_clusters", "platt_fit"}

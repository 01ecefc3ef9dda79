"""The driver's contract, and every query with SQL against DuckDB on the smallest tables."""

import os
from collections import Counter

import pandas as pd
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = sorted(k for k in entry.oracle_sql() if not k.startswith(("p1_", "p3_", "p4_", "p5_", "p8_", "p9_", "p10_")))


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def compared(df):
    out = Counter()
    for row in df[sorted(df.columns)].itertuples(index=False):
        out[tuple(None if pd.isna(v) else round(float(v), 5) if isinstance(v, float) else str(v) for v in row)] += 1
    return out


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    import duckdb

    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{DATA}/{f}'")
    return c


def check(spark, duck, name):
    a, b = entry.queries()[name](spark, DATA).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    whole = lambda df: df.astype({c: "object" for c in df.columns})
    assert compared(whole(a)) == compared(whole(b))


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, duck, name):
    check(spark, duck, name)


def test_flagship(spark):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    df = entry.entry(spark)
    assert df.columns == ["manifest_id", "dest_path", "field"] and df.count() > 0

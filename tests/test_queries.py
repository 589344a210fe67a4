"""Each registered query of the library against its SQL, on the smallest tables."""

import datetime
import decimal
import glob
import math
import os

import duckdb
import pandas as pd
import pytest

from lorebase.plans import queries

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
            return None
        if isinstance(v, (float, decimal.Decimal)):
            return round(float(v), 6) + 0.0
        return str(pd.Timestamp(v)) if isinstance(v, (datetime.date, pd.Timestamp)) else v

    return sorted(repr([plain(v) for v in r]) for r in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, D).toPandas()
    if name in queries.SQL:
        want = duck.execute(queries.SQL[name]).fetchdf()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    else:
        assert len(got)

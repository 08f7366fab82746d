"""Registered queries against their SQL, on the small tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.oracle_sql()]


def rows(df):
    out = []
    for r in df[sorted(df.columns)].astype(object).itertuples(index=False):
        out.append(tuple(None if v is None or v != v else round(float(v), 6) + 0.0 if isinstance(v, float) and math.isfinite(v) else str(v) for v in r))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sf_dir, duck, name):
    assert rows(entry.queries()[name](spark, sf_dir).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


def test_entry(spark):
    assert len(entry.entry(spark).columns) > 3

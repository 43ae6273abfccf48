"""The driver's contract: every query with SQL agrees with DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.plans import registry

from .conftest import SMALL


def value(x):
    return ("nan" if math.isnan(x) else float("%.9g" % x)) if isinstance(x, float) else x


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SMALL}/{f}'")
    return con


def same(spark, duck, name, query, sql):
    df = query(spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(([value(r[c]) for c in cols] for r in df.collect()), key=str)
    result = duck.execute(sql)
    names = [x[0] for x in result.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(([value(r[i]) for i in at] for r in result.fetchall()), key=str), name


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    same(spark, duck, name, registry.queries()[name], registry.oracle_sql()[name])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())

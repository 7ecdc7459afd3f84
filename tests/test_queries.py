"""Every registered query of the library against DuckDB on the smallest tables."""

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb
import pytest
from helixframe.plans import catalogue

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set TimeZone = 'UTC'")
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    rows = lambda got, names: Counter(repr([plain(r[names.index(c)]) for c in cols]) for r in got)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert len(catalogue.QUERIES[name](spark, SF).take(1)) == 1


def test_keys_are_keys(duck):
    for table, key in (("orders", "o_orderkey"), ("part", "p_partkey"), ("documents", "doc_id"), ("events", "event_id")):
        assert duck.sql(f"select count(*) = count(distinct {key}) from {table}").fetchall() == [(True,)]

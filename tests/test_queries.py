"""Every core query against the same in SQL on an independent engine, on the smallest tables."""

from __future__ import annotations

import datetime
import decimal
import math
import os

import pytest

from tessella.plans.queries import QUERIES, SQL


def even(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    return str(v)


@pytest.fixture(scope="module")
def engine(data):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(data):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(name, spark, data, engine):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted((tuple(even(x) for x in r) for r in df.select(*columns).collect()), key=str)
    cursor = engine.execute(SQL[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(even(r[i]) for i in at) for r in cursor.fetchall()), key=str)
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs_twice_alike(name, spark, data):
    one = QUERIES[name](spark, data)
    first = sorted(map(str, one.collect()))
    assert first == sorted(map(str, QUERIES[name](spark, data).collect()))
    assert one.columns

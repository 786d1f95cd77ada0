"""Every query that has SQL gives the rows of its SQL on the smallest tables; the others run."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SQL, QUERIES = entry.oracle_sql(), entry.queries()


def norm(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def rows(data, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(data):
        c.execute(f"create view {f[:-8]} as select * from read_parquet('{data}/{f}')")
    return c


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL and QUERIES[n].__module__ != "strandline.llm.queries"])
def test_sql(spark, data, con, name):
    df = QUERIES[name](spark, data)
    r = con.execute(SQL[name])
    names = [x[0] for x in r.description]
    assert sorted(names) == sorted(df.columns)
    assert rows([tuple(x) for x in df.collect()], df.columns) == rows(r.fetchall(), names)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SQL and QUERIES[n].__module__ != "strandline.llm.queries"])
def test_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["id", "root_id", "true_depth"]

import duckdb
import pytest

from strandline.llm import queries as Q


@pytest.mark.parametrize("name", [*Q.QUERIES])
def test_runs(spark, data, name):
    df = Q.QUERIES[name](spark, data)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in Q.SQL:
        c = duckdb.connect()
        c.execute("set timezone = 'UTC'")
        c.execute(f"create view messages as select * from read_parquet('{data}/messages.parquet')")
        r = c.execute(Q.SQL[name])
        names = [x[0] for x in r.description]
        want = sorted(tuple(x[names.index(n)] for n in df.columns) for x in r.fetchall())
        assert sorted(map(tuple, rows)) == want

import duckdb
import pytest

from assayer.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    con.execute(queries.SQL[name])
    columns = [d[0] for d in con.description]
    df = queries.QUERIES[name](spark, sf)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(columns).collect()), key=repr) == sorted(con.fetchall(), key=repr)

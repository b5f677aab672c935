"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from assayer.operators import registry

registry.load()
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_rows(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    con = duck.execute(registry.SQL[name])
    columns = [d[0] for d in con.description]
    assert sorted(df.columns) == sorted(columns)
    got, want = rows(df.columns, df.collect()), rows(columns, con.fetchall())
    assert len(got) == len(want)
    assert len(want) > 0
    for g, w in zip(got, want, strict=True):
        for a, b in zip(g, w, strict=True):
            if isinstance(a, float) and isinstance(b, float):
                assert math.isclose(a, b, rel_tol=1e-6, abs_tol=2e-4), (g, w)
            else:
                assert a == b, (g, w)

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quillstack.plans import objects, pipeline, reference

CORE = {**reference.QUERIES, **objects.QUERIES, **pipeline.QUERIES}


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        p = f"{sf}/{f}"
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def test_registered():
    assert set(CORE) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, sf, duck, name):
    df = CORE[name](spark, sf)
    rows = df.collect()
    sql = {**reference.SQL, **objects.SQL, **pipeline.SQL}.get(name)
    if sql:
        out = duck.execute(sql)
        names = [d[0] for d in out.description]
        want = sorted((tuple(plain(dict(zip(names, r))[c]) for c in sorted(names)) for r in out.fetchall()), key=repr)
        assert sorted(names) == sorted(df.columns)
        assert sorted((tuple(plain(r[c]) for c in sorted(names)) for r in rows), key=repr) == want

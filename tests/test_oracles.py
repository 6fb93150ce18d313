"""Every query with SQL gives what DuckDB gives on the smallest tables; every other one runs."""

import math
from collections import Counter
from decimal import Decimal

import duckdb
import pytest

from folioscope.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    return v


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_duckdb(spark, duck, sf, name):
    df = registry.QUERIES[name](spark, sf)
    relation = duck.sql(registry.SQL[name])
    columns = [d[0] for d in relation.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = Counter(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    theirs = Counter(repr(tuple(plain(r[columns.index(c)]) for c in order)) for r in relation.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, sf, name):
    df = registry.QUERIES[name](spark, sf)
    rows = df.collect()
    assert df.columns and (rows or name in ("undo_steps",))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

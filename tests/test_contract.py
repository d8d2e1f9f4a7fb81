"""Every query of the core that has SQL gives the SQL's rows."""

import math
import os

import pytest

from loomwright.plans import registry

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def views(small):
    c = duckdb.connect()
    for f in os.listdir(small):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    return c


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, small, views, name):
    df = registry.QUERIES[name](spark, small)
    columns = sorted(df.columns)
    got = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLES:
        return
    rel = views.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(rel.columns) == columns
    assert got == sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())

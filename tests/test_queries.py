"""Registered queries against their SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from tallyframe.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame):
    frame = frame[sorted(frame.columns)]
    cell = lambda x: "null" if not hasattr(x, "__len__") and pd.isna(x) else f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    if name not in registry.oracle_sql():
        assert len(got) > 0
        return
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


def test_entry_points_import(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())

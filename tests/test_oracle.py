"""Every query that SQL can express gives the rows that SQL gives."""

import math
import os

import duckdb
import pandas as pd
import pytest

from geoloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def rows(df: pd.DataFrame) -> list:
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        return None if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v) else v

    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, db, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    want = db.execute(registry.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLE_SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 11
    assert set(entry.oracle_sql()) <= set(entry.queries())

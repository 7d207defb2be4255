"""Every registered query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from tidewire.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations benchmark embeddings".split()


@pytest.fixture(scope="module")
def db(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 9) if isinstance(v, float) else v


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, tiny, db, name):
    got = catalog.queries()[name](spark, tiny).toPandas()
    want = db.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_gives_rows(spark, tiny, name):
    assert catalog.queries()[name](spark, tiny).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    top = entry.entry(spark)
    assert top.columns == ["id", "source_name", "final_score", "published"]
    assert top.count() == 20

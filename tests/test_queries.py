"""Every query with SQL gives the rows that DuckDB gives, on the same tables."""

import numbers
import os

import duckdb
import pandas as pd
import pytest

from skein.plans import registry

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DIR):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{DIR}/{name}'")
    return con


def rows(frame: pd.DataFrame):
    frame = frame[sorted(frame.columns)]
    tidy = lambda v: None if v is None or v is pd.NaT or v is pd.NA or v != v else float(round(v, 6)) if isinstance(v, numbers.Number) else v
    return sorted((tuple(tidy(v) if not hasattr(v, "__len__") or isinstance(v, str) else tuple(v) for v in r) for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DIR).toPandas()
    want = duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_runs(spark, name):
    assert registry.queries()[name](spark, DIR).count() > 0

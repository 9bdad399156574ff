"""Every table query against its SQL, on the small tables."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd
import pytest

from tessitura.plans import layout_queries, score_queries, table_queries  # noqa: F401  (their queries register themselves)

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for name in os.listdir(SF):
        found.sql(f"create view {name.removesuffix('.parquet')} as select * from '{SF}/{name}'")
    return found


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
        return "null"
    if isinstance(x, (int, float)) or hasattr(x, "dtype"):
        return repr(round(float(x), 6)) if str(getattr(x, "dtype", "int"))[0] != "b" else str(bool(x))
    return str(x)


def rows(frame: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(table_queries.SQL))
def test_equals_sql(spark, duck, name):
    got = table_queries.QUERIES[name](spark, SF).toPandas()
    want = duck.sql(table_queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(table_queries.QUERIES) - set(table_queries.SQL)))
def test_runs(spark, name):
    assert table_queries.QUERIES[name](spark, SF).count() > 0

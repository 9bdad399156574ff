"""The two queries that attach suppliers to customers, against their SQL on tables with odd balances and keys."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tessitura.operators import joins
from tessitura.plans import table_queries

from .test_table_queries import rows

INF, NAN = float("inf"), float("nan")
CUSTOMERS = "c_custkey long, c_acctbal double, c_nationkey int"
SUPPLIERS = "s_suppkey long, s_acctbal double, s_nationkey int"


def against_sql(spark, path, customers, suppliers, without=()):
    spark.createDataFrame(customers, CUSTOMERS).coalesce(1).write.parquet(f"{path}/customer.parquet")
    spark.createDataFrame(suppliers, SUPPLIERS).coalesce(1).write.parquet(f"{path}/supplier.parquet")
    duck = duckdb.connect()
    for name in ("customer", "supplier"):
        duck.sql(f"create view {name} as select * from '{path}/{name}.parquet/*.parquet'")
    for name in ("nearest_anchor", "scored_attach"):
        frames = table_queries.QUERIES[name](spark, str(path)).toPandas(), duck.sql(table_queries.SQL[name]).df()
        got, want = (rows(x.drop(columns=[c for c in without if c in x.columns])) for x in frames)
        assert len(want) > 0
        assert got == want, name


def test_odd_balances(spark, tmp_path):
    odd = [None, INF, -INF, 1e300, -1e300, 0.0, -0.0, 5.0, 5.0]
    customers = [(i, b, n) for i, (b, n) in enumerate((b, n) for b in [*odd, 4.99, 499.99, 500.0, 9000.0] for n in (1, 2, 3, 4, None, 9))]
    suppliers = [(i, b, n) for i, (b, n) in enumerate([*((b, 1) for b in odd), (5.01, 2), (4.99, 2), (5.01, 2), (None, 3), (4.0, 3), (None, 4), (3.0, None), (-7000.0, 2), (8000.0, 3)])]
    against_sql(spark, tmp_path, customers, [*suppliers, (None, 5.0, 1), (None, 5.01, 2)])


def test_not_a_number(spark, tmp_path):
    against_sql(spark, tmp_path, [(1, NAN, 1), (2, 5.0, 1), (3, None, 1), (4, 5.0, 2), (5, NAN, 2)], [(1, NAN, 1), (2, 5.5, 1), (3, None, 1), (4, 5.25, 2), (5, 6.0, 2)])


def test_customers_with_one_key(spark, tmp_path):
    against_sql(spark, tmp_path, [(1, 10.0, 1), (1, 700.0, 2), (1, 10.0, 1), (2, None, 1), (2, 20.0, 2), (None, 5.0, 1), (None, 6.0, 2)], [(7, 12.0, 1), (8, 701.0, 2), (6, 8.0, 1)])


def test_distances_that_floating_point_cannot_tell_apart(spark, tmp_path):
    suppliers = [(50 - i, i * 1e-20, 1) for i in range(40)] + [(100 - i, 1e17 + 16 * i, 2) for i in range(20)] + [(200 - i, float(i), 2) for i in range(20)]
    against_sql(spark, tmp_path, [(1, 100.0, 1), (2, 1e-20, 1), (3, -300.0, 1), (4, 1e17, 2), (5, 1e17 + 64, 2), (6, -1e17, 2), (7, 5.0, 2)], suppliers, without=["distance"])  # DuckDB rounds 1e17 to 9.999999999999998e16


@pytest.mark.parametrize("seed", range(3))
def test_random_balances(spark, tmp_path, seed):
    r = random.Random(seed)
    balance = lambda: r.choice([round(r.uniform(-3000, 3000), 2), float(r.randrange(20)), round(r.gauss(0, 5), 1)])
    against_sql(spark, tmp_path, [(i, balance(), r.randrange(4)) for i in range(300)], [(r.randrange(100), balance(), r.randrange(5)) for _ in range(120)])


def test_one_key_with_many_rows_has_no_pairs(spark):
    """40,000 by 40,000 rows of one key; the order is by distance, so the nearest of even numbers to x + 0.25 is the one below or above."""
    left = spark.range(40000).select("id", (F.col("id") + 0.25).alias("a"), F.lit(1).alias("k"))
    right = spark.range(40000).select(F.col("id").alias("r"), (F.col("id") * 2.0).alias("b"), F.lit(1).alias("k"))
    got = joins.nearest_on_line(left, right, ["k"], ["id"], "a", "b", lambda a, b: [F.abs(a - b)], ["r"], width=1000.0)
    assert got.where(F.col("r") != F.floor((F.col("id") + 1) / 2)).count() == 0
    assert got.agg(F.count("*"), F.sum("distance")).first() == (40000, 20000 * 0.25 + 20000 * 0.75)

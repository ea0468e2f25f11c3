"""Every registered query against its SQL in DuckDB, over the smallest tables."""

from __future__ import annotations

import glob
import math
import os

import pytest

from tessel.plans import registered

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, float):
        return repr(round(value, 5) + 0.0)
    if isinstance(value, (list, tuple)):
        return str(list(value))
    return str(value)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in registered().items() if sql))
def test_matches_sql(spark, duck, name):
    function, sql = registered()[name]
    df = function(spark, SF)
    columns = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = duck.sql(sql)
    assert sorted(result.columns) == columns
    place = [result.columns.index(c) for c in columns]
    assert mine == sorted(tuple(plain(r[i]) for i in place) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in registered().items() if not sql))
def test_same_rows_for_any_partitioning(spark, name):
    function, _ = registered()[name]
    one = sorted(map(str, function(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert one and one == sorted(map(str, function(spark, SF).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

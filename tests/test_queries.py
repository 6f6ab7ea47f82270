"""Every query with SQL gives what DuckDB gives on the smallest data; the others give rows."""

import os

import duckdb
import pandas as pd
import pytest

from rasterloom import catalogue

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{DATA}/{file}'")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toPandas()
    if name not in catalogue.ORACLES:
        assert len(got)
        return
    want = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    order = lambda df: df[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False, atol=2e-6)


def test_partitions_change_nothing(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    found = []
    for parts in ("1", "4", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        found.append(catalogue.QUERIES["match_topk"](spark, DATA).toPandas().sort_values(["template_id", "rank"]).reset_index(drop=True))
    spark.conf.set("spark.sql.shuffle.partitions", before)
    pd.testing.assert_frame_equal(found[0], found[1])
    pd.testing.assert_frame_equal(found[0], found[2])

"""Every image query against the same in DuckDB's SQL."""

import glob
import os

import duckdb
import pytest

from lumenrow.plans import decoded_queries, image_queries, round_trips, view_queries  # noqa: F401

SF = __import__("os").environ.get("QUERY_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    shown = lambda v: f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted(tuple(shown(r[i]) for i in order) for r in values)


def test_every_query_has_sql():
    assert {*image_queries.QUERIES} == {*image_queries.ORACLE} and len(image_queries.QUERIES) > 50


@pytest.mark.parametrize("name", sorted(image_queries.QUERIES))
def test_query(spark, duck, name):
    df, want = image_queries.QUERIES[name](spark, SF), duck.sql(image_queries.ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())

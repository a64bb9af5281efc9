"""Corpus queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from lumenrow.llm import queries, sql

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(sql.ORACLE_SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), con.sql(sql.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in order)) for r in want.fetchall())

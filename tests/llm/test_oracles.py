"""Queries with a SQL twin against DuckDB."""

import duckdb
import pytest
from corpus_paths import SF

from servicepulse.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    rel = con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    want = sorted(rel.select(*df.columns).fetchall())
    assert sorted(map(tuple, df.collect())) == want and want

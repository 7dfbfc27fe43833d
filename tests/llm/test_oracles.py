"""The queries that SQL can express, against DuckDB on two scales."""

import duckdb
import pytest

from strandkeep.llm import queries
from strandkeep.sources.tables import TABLES


@pytest.mark.parametrize("name", queries.oracle_sql())
@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_equals_sql(spark, name, folder):
    duck = duckdb.connect()
    for table in TABLES:
        duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    ours, theirs = queries.queries()[name](spark, folder), duck.sql(queries.oracle_sql()[name])
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    got = sorted((tuple(r[c] for c in columns) for r in ours.collect()), key=str)
    assert got == sorted((tuple(r[theirs.columns.index(c)] for c in columns) for r in theirs.fetchall()), key=str) and got

"""Corpus queries that SQL can express, against DuckDB on the given tables."""

from pathlib import Path

import duckdb
import pytest

from linkstats.llm.oracle import SQL
from linkstats.llm.queries import all_queries

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="given tables are not here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    cursor = con.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    got = all_queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    expected = sorted(cursor.fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=repr) == expected and expected

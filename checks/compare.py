"""Run queries and their SQL on the same tables and compare the rows.

    python -m checks.compare [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb
from pyspark.sql import SparkSession


def duckdb_tables(sf: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path)[:-len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _key(row: tuple) -> tuple:
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def result_rows(names: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return [names[i] for i in order], sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=_key)


def difference(spark: SparkSession, con, fn, text: str, sf: str) -> str | None:
    """None when query and SQL agree on columns, types and all rows."""
    df = fn(spark, sf)
    names, got = result_rows(df.columns, df.collect())
    cursor = con.execute(text)
    expected_names, expected = result_rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(got) != len(expected):
        return f"{len(got)} rows, expected {len(expected)}"
    wrong = [(a, b) for a, b in zip(got, expected) if a != b]
    types = [(type(x), type(y)) for a, b in zip(got, expected) for x, y in zip(a, b)
             if x is not None and y is not None and type(x) is not type(y)]
    if wrong:
        return f"{len(wrong)} of {len(got)} rows differ, first {wrong[0]} ({names})"
    if types:
        return f"types differ: {types[0]}"
    return None


def local_session(cores: int = 8) -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{cores}]").appName("linkstats-checks")
             .config("spark.sql.shuffle.partitions", str(cores)).config("spark.ui.enabled", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.warehouse.dir", "/tmp/linkstats-warehouse")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main(args: list[str]) -> int:
    from checks.oracle import sql
    from checks.queries import all_queries
    sf = args[0] if args else "/root/testdata/sf0.01"
    texts, fns = sql(), all_queries()
    chosen = args[1:] or list(fns)
    spark, con, bad = local_session(), duckdb_tables(sf), 0
    for name in chosen:
        start = time.time()
        try:
            problem = difference(spark, con, fns[name], texts[name], sf) if name in texts else "no SQL"
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name} {time.time() - start:.1f}s {problem or ''}",
              flush=True)
    print(f"{len(chosen) - bad} of {len(chosen)} agree; SQL without query: {sorted(set(texts) - set(fns))}")
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))

"""Queries against DuckDB on the given tables.

The default choice covers every kind of operator; LINKSTATS_ALL_CHECKS=1 runs all
queries, as ``python -m checks.compare`` does.
"""

import os
from pathlib import Path

import pytest

from checks.compare import difference, duckdb_tables
from checks.oracle import sql
from checks.queries import all_queries

SF = "/root/testdata/sf0.001"
CHOSEN = """o_s2 o_s4 o_s5 o_s7 o_s10 o_s11 o_k4 o_k7 o_t1 o_p5 o_p12 o_p17 o_p20 o_f8 o_f10 o_j5 o_j6 o_j9
            o_a6 o_a17 o_a20 o_a21 o_w1 o_w4 o_w5 o_w6 q1 q3 q5 q8 q15 n2""".split()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="given tables are not here")


@pytest.fixture(scope="module")
def con():
    return duckdb_tables(SF)


def test_every_query_has_sql():
    assert set(sql()) == set(all_queries())


@pytest.mark.parametrize("name", list(all_queries()) if os.environ.get("LINKSTATS_ALL_CHECKS") else CHOSEN)
def test_query_agrees_with_sql(spark, con, name):
    assert difference(spark, con, all_queries()[name], sql()[name], SF) is None

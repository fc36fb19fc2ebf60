"""Ordered operators against brute force, with slices narrow enough to cross."""

from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkstats.operators.asof import asof_join
from linkstats.operators.enrich import with_span
from linkstats.operators import slices
from linkstats.operators.slices import (place_of, trim_ends, with_neighbour, with_row_number,
                                        within_time_limit)

START = datetime(2024, 1, 1)


def at(seconds):
    return START + timedelta(seconds=seconds)


def probe_frame(spark, probes):
    return spark.createDataFrame([(i, k, at(s)) for i, (k, s) in enumerate(probes)],
                                 "id int, key string, ts timestamp")


def state_frame(spark, states):
    return spark.createDataFrame([(k, at(s), v) for k, s, v in states],
                                 "skey string, at timestamp, mode int")


def brute_asof(probes, states):
    out = {}
    for i, (key, s) in enumerate(probes):
        held = [(t, v) for k, t, v in states if k == key and t <= s and key is not None]
        out[i] = (at(max(held)[0]), max(held)[1]) if held else (None, None)
    return out


def run_asof(spark, probes, states, seconds):
    joined = asof_join(probe_frame(spark, probes), state_frame(spark, states), {"key": "skey"}, "ts",
                       "at", {"m_ts": "at", "mode": "mode"}, seconds)
    return {r.id: (r.m_ts, r.mode) for r in joined.collect()}


def test_asof_edges(spark):
    states = [("a", 10, 1), ("a", 100, 2), ("b", 5, 3)]
    probes = [("a", 9.9), ("a", 10), ("a", 99), ("a", 100), ("a", 5000), ("b", 4), ("b", 7), (None, 50),
              ("c", 50)]
    got = run_asof(spark, probes, states, 60)
    assert got == brute_asof(probes, states)
    assert got[0] == (None, None) and got[1] == (at(10), 1) and got[4] == (at(100), 2)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(probes=st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.integers(0, 300)), min_size=1,
                       max_size=40),
       states=st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 300), st.integers(0, 9)),
                       max_size=40, unique_by=lambda s: s[:2]),
       seconds=st.sampled_from([1, 7, 1000]))
def test_asof_matches_brute_force(spark, probes, states, seconds):
    assert run_asof(spark, probes, states, seconds) == brute_asof(probes, states)


def test_asof_keeps_every_probe_of_a_hot_run(spark):
    # A third of all rows share one key and one instant.
    base = spark.range(30000).select(
        F.col("id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"), F.lit(at(100)).alias("ts"))
    states = state_frame(spark, [("hot", 40, 7), ("k1", 40, 8)])
    joined = asof_join(base, states, {"key": "skey"}, "ts", "at", {"mode": "mode"})
    counts = dict(joined.groupBy("mode").count().collect())
    assert counts[7] == 10000 and sum(counts.values()) == 30000


@pytest.mark.parametrize("direction", ["previous", "next"])
@pytest.mark.parametrize("seconds", [1, 30, 10000])
def test_neighbours_cross_slices(spark, direction, seconds):
    points = [("a", s) for s in (0, 1, 2, 59, 61, 400)] + [("b", 5)]
    df = probe_frame(spark, points)
    got = with_neighbour(df, ["key"], "ts", {"other": F.col("id")}, direction, ["id"], seconds)
    order = {"a": [0, 1, 2, 3, 4, 5], "b": [6]}
    step = -1 if direction == "previous" else 1
    expected = {}
    for ids in order.values():
        for place, i in enumerate(ids):
            there = place + step
            expected[i] = ids[there] if 0 <= there < len(ids) else None
    assert {r.id: r.other for r in got.collect()} == expected
    assert got.columns == ["id", "key", "ts", "other"]


def test_neighbours_of_equal_times_use_the_tiebreak(spark):
    df = spark.createDataFrame([(i, "a", at(0)) for i in (3, 1, 2)], "id int, key string, ts timestamp")
    got = with_neighbour(df, ["key"], "ts", {"before": F.col("id")}, "previous", ["id"])
    assert {r.id: r.before for r in got.collect()} == {1: None, 2: 1, 3: 2}


@pytest.mark.parametrize("seconds", [1, 30, 10000])
def test_row_numbers_continue_across_slices(spark, seconds):
    df = probe_frame(spark, [("a", 7 * i) for i in range(40)] + [("b", 1), ("b", 500)])
    got = {r.id: r.n for r in with_row_number(df, ["key"], "ts", "n", ["id"], seconds).collect()}
    assert got == {i: i + 1 for i in range(40)} | {40: 1, 41: 2}


def test_span_of_the_last_state_is_zero(spark):
    states = spark.createDataFrame(
        [(1, "op0", at(0.25), 1), (1, "op1", at(10), 2), (1, "op0", at(60.25), 3)],
        "sched_id int, iif_name string, ts timestamp, seq_no int")
    assert {r.seq_no: r.span for r in with_span(states).collect()} == {1: 60.0, 2: 0.0, 3: 0.0}


def test_trim_ends_drops_single_samples(spark, rows):
    df = spark.createDataFrame([("r1", 1), ("r1", 2), ("r1", 3), ("r2", 9), ("r3", 1), ("r3", 2)],
                               "rec string, n int")
    assert rows(trim_ends(df, ["rec"], ["n"])) == [("r1", 2)]


def test_time_limit_keeps_the_first_late_row(spark):
    df = probe_frame(spark, [("a", s) for s in (0, 5.9, 6.0, 7.0, 8.0)] + [("b", 0), ("b", 2)])

    def kept(limit):
        return sorted(r.id for r in within_time_limit(df, ["key"], "ts", limit).collect())

    assert kept(5) == [0, 1, 2, 5, 6]
    assert kept(0) == [0, 1, 2, 3, 4, 5, 6]
    started = df.withColumn("begin", F.lit(at(-4)))
    ids = sorted(r.id for r in within_time_limit(started, ["key"], "ts", 5, start="begin").collect())
    assert ids == [0, 1, 5, 6]


def test_copies_of_a_state_count_once(spark):
    # Copies share their instant; of two different states at one instant the greater wins.
    states = [("a", 10, 1)] * 500 + [("a", 10, 2)] + [("b", 3, 4)] * 3
    got = run_asof(spark, [("a", 10), ("a", 200), ("b", 3)], states, 60)
    assert got == {0: (at(10), 2), 1: (at(10), 2), 2: (at(3), 4)}


def test_probe_kinds(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "n int")
    got = df.select(slices.probe_kind("n").alias("a"), slices.probe_kind("n", "connect").alias("b")).collect()
    assert [tuple(r) for r in got] == [("CONN", "CONN"), ("ECHO", "CONN"), (None, None)]
    with pytest.raises(ValueError, match="unknown probe mode"):
        slices.probe_kind("n", "other")


def test_places_keep_the_order_of_times_and_ties(spark):
    rows = [(datetime(1970, 1, 1), 5), (datetime(1969, 12, 31, 23, 59, 59, 999999), 1 << 62), (datetime(9999, 1, 1), -(1 << 63)),
            (datetime(9999, 1, 1), (1 << 63) - 1), (datetime(1970, 1, 1), -5), (datetime(1, 1, 2), 0)]
    df = spark.createDataFrame(rows, "ts timestamp, n long")
    placed = df.withColumn("place", place_of(df, ["ts", "n"]))
    assert placed.where("place IS NULL").count() == 0
    assert [tuple(r)[:2] for r in placed.orderBy("place").collect()] == [tuple(r) for r in df.orderBy("ts", "n").collect()]

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from linkstats.functions import measures as m
from linkstats.functions import records, times


def test_mode_labels_include_null_and_unlisted(spark, rows):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 4, 5, 9, None)], "code int")
    got = dict(rows(df.select("code", m.device_mode("code"))))
    assert got == {0: "UNKNOWN", 1: "DISCONNECTED", 2: "NO SERVICE", 3: "2G", 4: "3G", 5: "LTE",
                   9: "?", None: "?"}


@pytest.mark.parametrize("mode, rssi, rsrq, rsrp, expected", [
    (5, None, -7, -102, "GOOD"), (5, None, -8, -102, "FAIR"), (5, None, -7, -103, "FAIR"),
    (5, None, -11, -111, "FAIR"), (5, None, -12, -111, "POOR"), (5, None, -11, -112, "POOR"),
    (3, -69, None, None, "GOOD"), (4, -70, None, None, "FAIR"), (4, -94, None, None, "FAIR"),
    (3, -95, None, None, "POOR"), (0, -50, -1, -50, "POOR"), (1, -50, -1, -50, "POOR"),
    (2, -50, -1, -50, "POOR"), (None, None, None, None, "POOR"), (5, -50, None, None, "POOR"),
])
def test_signal_quality_thresholds(spark, mode, rssi, rsrq, rsrp, expected):
    df = spark.createDataFrame([(mode, rssi, rsrq, rsrp)],
                               "dev_mode int, rssi int, lte_rsrq int, lte_rsrp int")
    m.register_sql_functions(spark)
    row = df.select(m.signal_quality().alias("q"), F.expr(
        "signal_quality(dev_mode, rssi, lte_rsrq, lte_rsrp)").alias("s"),
        F.expr("device_mode(dev_mode)").alias("label")).first()
    assert (row.q, row.s) == (expected, expected)


def test_round_half_away_and_ties(spark):
    df = spark.createDataFrame([(2.5, 0), (-2.5, 0), (0.15, 1), (1.005, 2), (0.1 + 0.2 + 0.05, 1)],
                               "v double, d int")
    got = [df.where(F.col("d") == d).select(m.round_to("v", d)).collect() for d in (0, 1, 2)]
    assert sorted(r[0] for r in got[0]) == [-3.0, 3.0]
    assert sorted(r[0] for r in got[1]) == [0.2, 0.4]
    assert got[2][0][0] == 1.01


def test_ratio_and_gains_are_null_safe(spark):
    df = spark.createDataFrame([(3, 2), (3, 0), (None, 2), (3, None)], "t int, b int")
    got = [tuple(r) for r in df.select(m.ratio("t", "b"), m.stored_gain("t", "b"),
                                       m.reported_gain("t", "b")).collect()]
    assert got == [(1.5, 0.5, 50.0)] + [(None, None, None)] * 3


def test_arms_exclude_null_tool(spark, rows):
    arms = m.Arms("x-")
    df = spark.createDataFrame([("x-ping",), ("ping",), (None,)], "run_tool string")
    assert rows(df.where(arms.is_treatment())) == [("x-ping",)]
    assert rows(df.where(arms.is_baseline())) == [("ping",)]


@pytest.mark.parametrize("row, expected", [
    ((4, 4, 10, 2, 7), 0.7),     # op0 is default: op1 runs moved away
    ((4, 3, 10, 2, 7), 0.2),     # else op0 runs moved away
    ((4, 4, 0, 0, 0), None), ((None, 0, 10, 5, 1), 0.5), ((4, 4, None, 1, 1), None)])
def test_non_default_share(spark, row, expected):
    df = spark.createDataFrame([row], "cnt int, cnt_op0 int, cnt_t int, cnt_op0_t int, cnt_op1_t int")
    assert df.select(m.non_default_share()).first()[0] == expected


@pytest.mark.parametrize("amount, expected", [
    (0.0, "0 B"), (1000.0, "1000 B"), (1001.0, "1.0 kB"), (1450.0, "1.4 kB"), (1250.0, "1.2 kB"),
    (1e6, "1000.0 kB"), (1000001.0, "1.00 MB"), (5e9, "5.000 GB"), (1e28, None)])
def test_human_size(spark, amount, expected):
    df = spark.createDataFrame([(amount,)], "v double")
    assert df.select(m.human_size("v")).first()[0] == expected


def test_protocol_names(spark):
    df = spark.createDataFrame([(1,), (2,), (3,), (7,), (None,)], "p int")
    assert [r[0] for r in df.select(m.protocol_name("p")).collect()] == [
        "TCP", "SCTP", "SCTP/UDP", "OTHER", "OTHER"]


def test_times(spark):
    df = spark.createDataFrame([("20240105", "101500", 1704449600.25)], "d string, c string, e double")
    row = df.select(times.name_timestamp("d", "c"), times.name_epoch("d", "c"),
                    times.epoch_timestamp("e"), times.micros(times.epoch_timestamp("e"))).first()
    assert row[0] == datetime(2024, 1, 5, 10, 15)
    assert row[1] == 1704449700
    assert row[3] == 1704449600250000
    short = spark.createDataFrame([("2024", "1015")], "d string, c string")
    assert short.select(times.name_timestamp("d", "c")).first()[0] is None


def test_narrowing_modes(spark):
    df = spark.createDataFrame([(-200,), (127,), (-129,), (None,)], "v int")
    wrapped = [r[0] for r in df.select(records.narrow("v", 8, True, "wrap")).collect()]
    assert wrapped == [56, 127, 127, None]
    assert [r[0] for r in df.select(records.narrow("v", 8, mode="null")).collect()] == [None, 127, None, None]
    unsigned = [r[0] for r in df.select(records.narrow("v", 8, False, "wrap")).collect()]
    assert unsigned == [56, 127, 127, None]
    with pytest.raises(PySparkException, match="does not fit"):
        df.select(records.narrow("v", 8, True, "fail")).collect()


def test_collation_is_opt_in(spark, rows):
    df = spark.createDataFrame([("T-Ping", "OP0"), ("t-ping", "op0"), ("ping", "op0")], "run_tool string, if_name string")
    arms = m.Arms()
    assert df.where(arms.is_treatment()).count() == 1
    folded = m.collated(df, ["run_tool", "if_name"])
    assert folded.where(arms.is_treatment()).count() == 2
    assert df.groupBy("if_name").count().count() == 2
    assert [r["count"] for r in folded.groupBy("if_name").count().collect()] == [3]

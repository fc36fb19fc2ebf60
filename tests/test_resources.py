import random
from datetime import datetime, timedelta

import pytest

from linkstats.operators import flows, policy, resources

WIDE = ("recording string, n int, cpu double, total bigint, avail bigint, "
        + ", ".join(f"{s}_name string, {s}_cpu double, {s}_pss bigint"
                    for s in ("app", "exporter", "policyd", "proxy")))
MIB = 1048576


def sample(n, cpu, app, app_cpu=None, app_pss=None, exporter=None, policyd=None, proxy=None):
    slots = []
    for name, value in (("exporter", exporter), ("policyd", policyd), ("proxy", proxy)):
        slots += [name, value, MIB] if value is not None else [None, None, None]
    return ("r", n, cpu, 10 * MIB, 4 * MIB, app, app_cpu, app_pss, *slots)


SAMPLES = [
    sample(0, 90.0, "(no-app)"),                                   # first: dropped
    sample(1, 1.0, "(no-app)"),
    sample(2, 3.0, "(no-app)"),
    sample(3, 10.0, "tcp-ping", 8.0, 2 * MIB),
    sample(4, 20.0, "tcp-ping", None, 4 * MIB, exporter=4.0),      # exporter is no baseline key
    sample(5, 30.0, "t-dwnl-test", 12.0, MIB, exporter=8.0, policyd=16.0),
    sample(6, 40.0, "dwnl-test", 4.0, MIB, proxy=20.0),
    sample(7, 50.0, None),                                         # blank slot: no category
    sample(8, 60.0, "(no-app)", exporter=1.0),                     # not idle: a daemon runs
    sample(9, 99.0, "(no-app)"),                                   # last: dropped
]


def test_overhead_report(spark, rows):
    df = spark.createDataFrame(SAMPLES, WIDE)
    got = {(c, k): (n, v) for c, k, n, v in rows(resources.overhead_report(df, order=["n"]))}
    assert got == {
        ("idle", "cpu"): (2, 2.0), ("idle", "mem"): (2, 6.0),
        ("baseline", "cpu"): (2, 15.0), ("baseline", "mem"): (2, 6.0),
        ("baseline", "tcp-ping-cpu"): (1, 2.0), ("baseline", "tcp-ping-mem"): (2, 3.0),
        ("treatment", "cpu"): (1, 30.0), ("treatment", "mem"): (1, 6.0),
        ("treatment", "t-dwnl-test-cpu"): (1, 3.0), ("treatment", "t-dwnl-test-mem"): (1, 1.0),
        ("treatment", "exporter-cpu"): (1, 2.0), ("treatment", "exporter-mem"): (1, 1.0),
        ("treatment", "policyd-cpu"): (1, 4.0), ("treatment", "policyd-mem"): (1, 1.0),
        ("proxy", "cpu"): (1, 40.0), ("proxy", "mem"): (1, 6.0),
        ("proxy", "dwnl-test-cpu"): (1, 1.0), ("proxy", "dwnl-test-mem"): (1, 1.0),
        ("proxy", "proxy-cpu"): (1, 5.0), ("proxy", "proxy-mem"): (1, 1.0)}


def test_single_sample_recordings_report_nothing(spark):
    assert resources.overhead_report(spark.createDataFrame(SAMPLES[:1], WIDE), order=["n"]).collect() == []


T0 = datetime(2024, 1, 1)


def at(s):
    return T0 + timedelta(seconds=s)


def test_present_twice_needs_the_sample_before(spark, rows):
    df = spark.createDataFrame([("r", at(0), "a"), ("r", at(5), "a"), ("r", at(5), "b"), ("r", at(100), "b"),
                                ("r", at(105), "a"), ("s", at(5), "a")], "rec string, ts timestamp, p string")
    got = rows(resources.present_twice(df, ["rec"], "ts", "p"), "ts", "p")
    assert got == [(at(5), "a"), (at(100), "b")]
    clock = spark.createDataFrame([("r", at(s)) for s in (0, 5, 50, 100, 105)] + [("s", at(5))],
                                  "rec string, ts timestamp")
    assert rows(resources.present_twice(df, ["rec"], "ts", "p", clock), "ts", "p") == [(at(5), "a")]


def test_tool_slot_priority(spark, rows):
    df = spark.createDataFrame([(1, "dwnl-test"), (1, "t-tcp-ping"), (2, "exporter"), (3, "tcp-ping"),
                                (3, "t-tcp-ping")], "k int, p string")
    assert rows(resources.tool_of_sample(df, ["k"], "p")) == [(1, "t-tcp-ping"), (2, "(no-app)"), (3, "tcp-ping")]


def test_flow_summary_and_rates(spark):
    df = spark.createDataFrame([(1, at(0), 1000, 2, 1000), (1, at(2), 3000, 1, 4000), (2, at(0), 5, 9, 5),
                                (1, at(2), 1, 1, 4001)],
                               "flow_id bigint, ts timestamp, bytes bigint, protocol int, bytes_total bigint")
    got = {r.flow_id: r for r in flows.flow_summary(df).collect()}
    a = got[1]
    assert (a.bytes, a.reads, a.duration, a.bandwidth, a.protocol) == (4001, 3, 2.0, 16004.0, "TCP")
    assert (a.size_text, a.bandwidth_text) == ("4.0 kB", "16.0 kBit/s")
    assert (got[2].duration, got[2].bandwidth, got[2].bandwidth_text, got[2].protocol) == (0.0, None, None, "OTHER")
    rates = {r.bytes_total: r for r in flows.interval_rate(df, tiebreak=["bytes_total"]).collect()}
    assert rates[1000].rate_bps is None and rates[5].rate_bps is None
    assert (rates[4000].interval_bytes, rates[4000].rate_bps) == (3000, 12000.0)
    assert rates[4001].rate_bps is None and rates[4001].interval_seconds == 0.0


RULES = [("m", "match", "device_mode", 4.0, 4.0, None), ("m", "match", "rssi", -128.0, 0.0, None),
         ("m", "property", "rssi", -128.0, -95.0, 0.0), ("m", "property", "rssi", -94.0, -70.0, 15.0),
         ("d", "match", "device_mode", 3.0, 3.0, None), ("d", "match", "device_mode", 4.0, 4.0, None),
         ("d", "property", "device_mode", 4.0, 4.0, 10.0)]


@pytest.fixture
def rules(spark):
    return spark.createDataFrame(RULES, "uid string, role string, name string, lo double, hi double, score double")


def test_policy_scores(spark, rows, rules):
    states = spark.createDataFrame(
        [("a", 4, -80), ("b", 4, None), ("c", 3, -80), ("d", 5, -80), ("e", 4, -100)],
        "if_name string, device_mode int, rssi int")
    readings = ("device_mode", "rssi")
    got = rows(policy.rule_scores(states, rules, ["if_name"], readings))
    assert got == [("a", "d", 10.0), ("a", "m", 15.0), ("b", "d", 10.0), ("c", "d", 0.0), ("e", "d", 10.0),
                   ("e", "m", 0.0)]
    scores = policy.state_scores(states, rules, ["if_name"], readings)
    assert rows(scores) == [("a", 25.0, 2), ("b", 10.0, 1), ("c", 0.0, 1), ("e", 10.0, 2)]


def test_rules_without_condition_with_text_and_with_overlaps(spark, rows):
    rules = spark.createDataFrame(
        [("free", "property", 0, "rssi", -100.0, 0.0, None, 3.0),
         ("text", "match", 0, "interface", None, None, "op0", None),
         ("text", "property", 0, "interface", None, None, "op0", 2.0),
         ("text", "property", 1, "interface", None, None, "op0", 2.0),
         ("wide", "match", 0, "rssi", -128.0, -60.0, None, None), ("wide", "match", 0, "rssi", -90.0, 0.0, None, None),
         ("wide", "property", 0, "rssi", -128.0, 0.0, None, 1.0)],
        "uid string, role string, group_no int, name string, lo double, hi double, text_value string, score double")
    states = spark.createDataFrame([(1, "op0", -80), (2, "op1", -120), (3, None, None)], "k int, interface string, rssi int")
    got = rows(policy.rule_scores(states, rules, ["k"], ("interface", "rssi")))
    assert got == [(1, "free", 3.0), (1, "text", 4.0), (1, "wide", 1.0), (2, "free", 0.0), (2, "wide", 1.0),
                   (3, "free", 0.0)]


def test_random_ranges_against_plain_comparison(spark, rows):
    rng = random.Random(4)
    entries = []
    for uid in range(30):
        for role in ("match", "property"):
            for name in rng.sample(("a", "b", "c"), rng.randrange(3)):
                lo = rng.choice([-2.5, -1.0, 0.0, 1.0, 1.5, 3.0])
                entries += [(f"r{uid}", role, rng.randrange(2), name, lo, lo + rng.randrange(-1, 4), None, 1.0 + uid)]
        entries += [(f"r{uid}", "property", 0, "c", None, None, rng.choice(["1.5", "x"]), 0.5)]
    states = [(k, *(rng.choice([None, -3.0, -2.5, -1.0, 0.2, 1.0, 1.5, 6.9]) for _ in "ab"), rng.choice([None, "1.5", "x", "0"]))
              for k in range(60)]
    frame = spark.createDataFrame(entries, "uid string, role string, group_no int, name string, lo double, hi double, "
                                           "text_value string, score double")
    got = rows(policy.rule_scores(spark.createDataFrame(states, "k int, a double, b double, c string"), frame, ["k"],
                                  ("a", "b", "c")))

    def holds(e, state):
        value = state["abc".index(e[3]) + 1]
        number = value if isinstance(value, float) else {"1.5": 1.5, "0": 0.0}.get(value)
        return (e[4] is not None and number is not None and e[4] <= number <= e[5]) or (e[6] is not None and value == e[6])

    expected = []
    for state in states:
        for uid in {e[0] for e in entries}:
            own = {e for e in entries if e[0] == uid}
            asked = {e[3] for e in own if e[1] == "match"}
            if asked == {e[3] for e in own if e[1] == "match" and holds(e, state)}:
                sums = {(e[2], e[3], e[7]) for e in own if e[1] == "property" and holds(e, state)}
                expected.append((state[0], uid, sum(s for *_, s in sums)))
    assert got == sorted(expected, key=repr)


def test_best_interface_breaks_ties_by_name(spark, rows):
    df = spark.createDataFrame([(1, "op0", 5.0), (1, "op1", 5.0), (1, "op2", 1.0)], "k int, if_name string, score double")
    assert rows(policy.best_interface(df, ["k"])) == [(1, "op1", 5.0)]

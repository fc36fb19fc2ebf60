from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from linkstats.functions.measures import Arms
from linkstats.operators import distributions as dist
from linkstats.operators import keys, summary
from linkstats.operators.summary import (download_summary, paired, ping_summary, tool_summary)
from linkstats.operators.totals import additive_parts, with_total
from linkstats.plans import reports
from linkstats.plans.campaign import Campaign
from linkstats.session import scratch_dir
from linkstats.sinks.summaries import SummaryStore
from linkstats.sinks.tables import replace_table
from linkstats.sinks.versions import Load, TableStore
from linkstats.sources.experiments import experiment_dimension

PING = ("exp_id int, sched_id int, node_id int, run_tool string, iter_nr int, if_name string, "
        "ping_type string, rtt double, dev_mode int, rssi int, lte_rsrq int, lte_rsrp int, oper int")
DWNL = ("exp_id int, sched_id int, node_id int, run_tool string, iter_nr int, if_name string, "
        "dwnl_size int, init_time double, total_time double, dev_mode int, rssi int, lte_rsrq int, "
        "lte_rsrp int, oper int")
PINGS = [
    (1, 10, 5, "tcp-ping", 1, "op0", "CONN", 0.08, 5, None, -6, -95, 24001),
    (1, 10, 5, "tcp-ping", 2, "op0", "ECHO", 0.05, 5, None, -6, -95, 24001),
    (1, 10, 5, "tcp-ping", 3, "op0", "ECHO", 0.07, 5, None, -6, -95, 24001),
    (1, 10, 5, "t-tcp-ping", 1, None, "CONN", 0.06, None, None, None, None, None),
    (1, 10, 5, "t-tcp-ping", 2, None, "ECHO", 0.03, None, None, None, None, None),
    (1, 11, 6, "tcp-ping", 1, "op1", "CONN", 0.10, 4, -80, None, None, 24002),
    (1, 11, 6, "tcp-ping", 2, "op1", "ECHO", 0.20, 4, -80, None, None, 24002),
]
DWNLS = [
    (1, 10, 5, "dwnl-test", 1, "op0", 1048576, 0.1, 1.1, 5, None, -6, -95, 24001),
    (1, 10, 5, "t-dwnl-test", 1, "op1", 2097152, 0.2, 1.2, 3, -70, None, None, 24002),
]
EXPERIMENTS = [(1, "Day-1", "2018-03-15 13:36", "b1"), (2, "Day-2", "2018-03-16 15:38", "b2")]


def campaign(spark, pings=PINGS, dwnls=DWNLS, batch="b1"):
    states = spark.createDataFrame(
        [(1, 10, "op0", 5, None, -6, -95, 30.0), (1, 10, "op1", 4, -80, None, None, 60.0),
         (1, 10, "op1", None, None, None, None, 10.0)],
        "exp_id int, sched_id int, iif_name string, dev_mode int, rssi int, lte_rsrq int, "
        "lte_rsrp int, span double")
    return Campaign(experiment_dimension(spark, EXPERIMENTS), spark.createDataFrame(pings, PING),
                    spark.createDataFrame(dwnls, DWNL), states, batch)


def test_ping_summary_null_and_zero_counts(spark):
    by = {r.sched_id: r for r in campaign(spark).ping_summary.collect()}
    a, b = by[10], by[11]
    assert (a.cnt_all, a.cnt_rtt, a.cnt, a.cnt_op0, a.cnt_op1, a.cnt_lte, a.cnt_good) == (5, 2, 1, 1, 0, 1, 1)
    assert a.rtt == pytest.approx(0.06) and a.init_time == pytest.approx(0.08)
    # The treatment probe has no interface, hence no state: it counts as POOR.
    assert (a.cnt_rtt_t, a.cnt_t, a.cnt_op0_t, a.cnt_poor_t) == (1, 1, 0, 1)
    assert a.rtt_gain == pytest.approx(-0.5) and a.cnt_gain == pytest.approx(-0.5)
    # No treatment at all: NULL counts and gains, zero category counts.
    assert (b.cnt_rtt_t, b.cnt_t, b.rtt_t, b.rtt_gain, b.cnt_gain) == (None,) * 5
    assert (b.cnt_op0_t, b.cnt_poor_t, b.cnt_fair) == (0, 0, 1)


def test_download_summary_speeds_and_gains(spark):
    r = campaign(spark).download_summary.first()
    assert r.dwnl_speed / 1048576 == pytest.approx(1.0)
    assert r.dwnl_speed_t / 1048576 == pytest.approx(2.0)
    assert (r.cnt_gain, r.size_gain) == (0.0, 1.0) and r.speed_gain == pytest.approx(1.0)


def test_zero_download_time_gives_no_speed(spark):
    still = [(1, 10, 5, "dwnl-test", 1, "op0", 100, 0.5, 0.5, 5, None, -6, -95, 1)]
    r = campaign(spark, dwnls=still).download_summary.first()
    assert (r.dwnl_time, r.dwnl_speed, r.speed_gain) == (0.0, None, None)


def test_merge_keeps_null_and_stack_keeps_rows(spark):
    c = campaign(spark)
    by = {r.sched_id: r for r in c.tool_summary.collect()}
    assert (by[10].cnt, by[10].cnt_t, by[10].cnt_op0) == (2, 2, 2)
    assert by[10].init_time == pytest.approx((0.08 + 0.1) / 2)
    assert (by[11].cnt, by[11].cnt_op1, by[11].init_time) == (None, None, None)
    stacked = tool_summary(c.ping_summary, c.download_summary, combine="stack")
    assert sorted(r.sched_id for r in stacked.collect()) == [10, 10, 11]
    with pytest.raises(ValueError):
        tool_summary(c.ping_summary, c.download_summary, combine="x")
    assert paired(c.ping_summary, c.download_summary).count() == 2


def test_other_arm_names(spark):
    arms = Arms("new_", "_new")
    df = campaign(spark).v_tcp_ping.withColumn("run_tool", F.regexp_replace("run_tool", "^t-", "new_"))
    r = {x.sched_id: x for x in ping_summary(df, arms).collect()}[10]
    assert r.cnt_rtt_new == 1 and r.rtt_gain == pytest.approx(-0.5)
    assert download_summary(campaign(spark).v_dwnl_test, arms).first().cnt_dwnl_new is None


def test_rtt_gain_report(spark, rows):
    got = {r.exp_name: r for r in reports.run("q1", campaign(spark)).collect()}
    r = got["Day-1 (2018-03-15 13:36:00)"]
    assert (r.cnt, r.cnt_t) == (3, 1)
    # Weighted by count: (2 * 60 + 1 * 200) / 3; a missing rtt_t drops from the numerator only.
    assert r.rtt_ms == 106.7 and r.rtt_ms_t == 30.0
    assert r.win_cnt_pct == 50.0
    assert tuple(got["TOTAL"])[1:] == tuple(r)[1:]


def test_reports_of_an_empty_batch_have_one_total(spark):
    for name in ("q1", "q2", "q3", "q8", "q9", "q12"):
        got = reports.run(name, campaign(spark, batch="none")).collect()
        assert [r.exp_name for r in got] == ["TOTAL"]
        values = {v for k, v in got[0].asDict().items() if k not in ("exp_name", "cnt")}
        assert values == {None}
    assert reports.run("q3", campaign(spark, batch="none")).first().cnt == 0
    assert reports.run("q1", campaign(spark, batch="none")).first().cnt is None
    assert reports.run("q15", campaign(spark, batch="none")).collect() == []


def test_state_distribution_counts_unlabelled_time(spark):
    r = reports.run("q8", campaign(spark)).where("exp_name = 'TOTAL'").first()
    # 10 of 100 seconds had no mode: in no column, but in the whole.
    assert (r["lte_pct"], r["3g_pct"], r["2g_pct"]) == (30.0, 60.0, 0.0)
    q = reports.run("q12", campaign(spark)).where("exp_name = 'TOTAL'").first()
    assert (q.good_pct, q.fair_pct, q.poor_pct) == (30.0, 60.0, 10.0)


def test_segments(spark):
    c = campaign(spark)
    # Schedule 10: all baseline runs on op0, one of two treatment runs on op1.
    share = {r.sched_id: r[1] for r in c.tool_summary.select("sched_id", reports.share_of(c.arms)).collect()}
    assert share == {10: 0.5, 11: None}
    assert reports.run("q4", c).count() == 2 and reports.run("q6", c).count() == 1
    assert reports.run("q10", c).where("exp_name = 'TOTAL'").first().cnt == 2


def test_breakdowns_are_ordered(spark):
    got = reports.run("q15", campaign(spark)).collect()
    assert [(r.device_mode, r.cnt, r.rtt_ms) for r in got] == [("?", 1, 30.0), ("LTE", 2, 60.0), ("3G", 1, 200.0)]
    speeds = reports.run("q19", campaign(spark)).collect()
    assert [(r.device_mode, r.speed_mbs) for r in speeds] == [("2G", 2.0), ("LTE", 1.0)]


@pytest.mark.parametrize("value, bucket", [
    (0.0, ["no_diff_pct"]), (0.0001, ["no_diff_pct", "to_20_pct"]), (0.2, ["to_20_pct"]),
    (0.2001, ["to_40_pct"]), (1.0, ["above_80_pct"]), (None, [])])
def test_histogram_edges(spark, value, bucket):
    df = spark.createDataFrame([(1, value)], "k int, share double")
    r = dist.share_histogram(df, ["k"], F.col("share")).first().asDict()
    assert [n for n, v in r.items() if n.endswith("_pct") and v] == bucket


def test_histogram_gap_only_without_scale(spark):
    df = spark.createDataFrame([(1, 0.20005)], "k int, share double")
    scaled = dist.share_histogram(df, ["k"], F.col("share")).first()
    literal = dist.share_histogram(df, ["k"], F.col("share"), None).first()
    assert scaled.to_40_pct == 100.0
    assert all(v == 0.0 for k, v in literal.asDict().items() if k.endswith("_pct"))


def test_total_equals_recomputation(spark):
    df = spark.range(1000).select((F.col("id") % 7).alias("g"), F.col("id").alias("v"))
    parts = additive_parts(df, ["g"], {"n": F.count("*"), "v": F.sum("v")})
    got = with_total(parts, ["g"], F.col("g").cast("string"), ["n", "v"], "name", ["n"]).collect()
    total = [r for r in got if r.name == "TOTAL"]
    assert len(got) == 8 and (total[0].n, total[0].v) == (1000, sum(range(1000)))


def test_key_checks(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, None)], "k int, v string")
    assert rows(keys.duplicate_keys(df, ["k"])) == [(1, 2)]
    with pytest.raises(keys.DuplicateKeyError):
        keys.require_unique(df, ["k"])
    assert keys.require_unique(df, ["k", "v"]) is df
    assert rows(keys.unique_mapping(df, ["k"], "v", strict=False)) == [(2, "a")]
    assert rows(keys.mapping_conflicts(df, ["k"], "v")) == [(1, "a", "b")]
    with pytest.raises(PySparkException, match="v changed for 1"):
        keys.unique_mapping(df, ["k"], "v").collect()


def test_dimension_label(spark):
    r = experiment_dimension(spark, EXPERIMENTS).where("exp_id = 1").first()
    assert r.exp_dtm == datetime(2018, 3, 15, 13, 36)


def facts_of(spark, rows):
    return spark.createDataFrame(
        [(1, s, 7, tool, n, "ECHO" if n > 1 else "CONN", rtt, "op0", "LTE", "GOOD") for s, tool, n, rtt in rows],
        "exp_id int, sched_id int, node_id int, run_tool string, iter_nr int, ping_type string, rtt double, if_name string, "
        "device_mode string, signal_quality string")


def test_stored_summaries_grow_by_loads_and_equal_a_rebuild(spark, rows, monkeypatch):
    loads = [[(1, "tcp-ping", 1, 0.1), (1, "tcp-ping", 2, 0.3), (2, "tcp-ping", 2, 0.7)],
             [(1, "t-tcp-ping", 2, 0.2), (3, "tcp-ping", 1, 0.9)], [(1, "tcp-ping", 3, 0.4)]]
    store = SummaryStore(spark, scratch_dir(spark, "sums"), buckets=2)
    for number, load in enumerate(loads):
        published = store.add(f"load{number}", ping_summary=facts_of(spark, load))
    whole = summary.ping_summary(facts_of(spark, sum(loads, [])))
    assert rows(store.read("ping_summary").select(*whole.columns)) == rows(whole)
    old = rows(store.read("ping_summary"))
    with monkeypatch.context() as patch:                     # a load that fails when its summaries are written
        write = Load.write
        patch.setattr(Load, "write", lambda self, name, *a: write(self, name, *a) if name.endswith("_parts") else 1 / 0)
        with pytest.raises(ZeroDivisionError):
            store.add("load3", ping_summary=facts_of(spark, [(1, "tcp-ping", 2, 9.0)]))
    assert rows(store.read("ping_summary")) == old
    again = [(1, "t-tcp-ping", 2, 0.6)]                      # load1 comes again without schedule 3
    after = store.add("load1", ping_summary=facts_of(spark, again))
    whole = summary.ping_summary(facts_of(spark, loads[0] + again + loads[2]))
    assert rows(store.read("ping_summary").select(*whole.columns)) == rows(whole)
    buckets = [p.tables["ping_summary"]["parts"] for p in (published, after)]
    store.add("load4", ping_summary=facts_of(spark, [(2, "tcp-ping", 1, 0.5)]))
    newest = TableStore(spark, store.root).current().tables["ping_summary"]["parts"]
    assert set(newest) <= set(buckets[0]) and sum(newest[b] != buckets[1].get(b) for b in newest) == 1


def test_a_table_is_pointed_to_its_new_rows_only_when_they_are_written(spark, rows):
    folder = scratch_dir(spark, "table")
    first = replace_table(spark.createDataFrame([(1, "a")], "k int, v string"), "linkstats_t", folder)
    assert rows(first) == [(1, "a")]
    broken = spark.createDataFrame([(2, "b")], "k int, v string").withColumn("v", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        replace_table(broken, "linkstats_t", folder)
    assert rows(spark.table("linkstats_t")) == [(1, "a")]
    assert rows(replace_table(spark.createDataFrame([(3, "c")], "k int, v string"), "linkstats_t", folder)) == [(3, "c")]
    assert rows(replace_table(spark.createDataFrame([(4,)], "k int"), "linkstats_t", folder)) == [(4,)]
    spark.sql("DROP TABLE linkstats_t")

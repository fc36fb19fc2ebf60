"""What the plans must and must not contain at scale."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks import queries, roles
from linkstats.operators import policy
from linkstats.operators.asof import asof_join
from linkstats.operators.enrich import with_span
from linkstats.operators.slices import with_neighbour, with_row_number
from linkstats.plans import reports
from linkstats.session import scratch_dir
from linkstats.sources.experiments import of_batch

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="given tables are not here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@needs_tables
@pytest.mark.parametrize("name", sorted(reports.REPORTS))
def test_reports_use_no_nested_loop_and_no_python(no_broadcast, name):
    text = plan(reports.run(name, roles.campaign(no_broadcast, SF)))
    for forbidden in ("NestedLoop", "CartesianProduct", "Python", "Broadcast"):
        assert forbidden not in text, f"{forbidden} in {name}"


def windows_of(text):
    return [line for line in text.splitlines() if re.search(r"\bWindow \[", line)]


@needs_tables
def test_big_windows_run_over_slices(no_broadcast):
    probes, states = roles.probes(no_broadcast, SF), roles.states(no_broadcast, SF)
    frames = [
        asof_join(probes, states, {"sched_id": "sched_id", "if_name": "iif_name"}, "run_dtm", "ts", {"m_ts": "ts"}),
        with_span(states), with_row_number(probes, ["sched_id"], "run_dtm", "n", ["event_id"]),
        with_neighbour(probes, ["sched_id"], "run_dtm", {"x": F.col("rtt")})]
    for frame in frames:
        found = windows_of(plan(frame))
        # One window over (key, slice) for the rows; one over the key for slice edges.
        assert len(found) == 2
        assert any("_slice" in line.split("windowspecdefinition(")[1].split(" ASC")[0] for line in found)


@needs_tables
def test_instants_are_reduced_once(no_broadcast):
    probes, states = roles.probes(no_broadcast, SF), roles.states(no_broadcast, SF)
    frame = asof_join(probes, states, {"sched_id": "sched_id", "if_name": "iif_name"}, "run_dtm", "ts",
                      {"m_ts": "ts"})
    frame.collect()
    assert "ReusedExchange" in plan(frame)


def test_batch_prunes_partitions_and_pushes_filters(spark):
    folder = scratch_dir(spark, "facts")
    (spark.range(1000).select((F.col("id") % 5).cast("int").alias("exp_id"), F.col("id").alias("sched_id"),
                              F.lit("ECHO").alias("ping_type"), F.rand(1).alias("rtt"), F.lit("x").alias("unused"))
     .write.partitionBy("exp_id").parquet(folder))
    facts = spark.read.parquet(folder)
    roles.experiments(spark).write.parquet(f"{folder}-dim")
    dim = spark.read.parquet(f"{folder}-dim")
    text = plan(of_batch(facts.where(F.col("ping_type") == "ECHO"), dim, "policy-1")
                .groupBy("exp_id").agg(F.avg("rtt")))
    assert "dynamicpruning" in text.lower()
    assert "EqualTo(ping_type,ECHO)" in text
    assert "unused" not in re.search(r"ReadSchema: (\S+)", text).group(1)


@needs_tables
def test_rules_meet_states_by_equality_of_interval_numbers(no_broadcast):
    text = plan(policy.rule_scores(queries.candidates(no_broadcast, SF), queries.stored_rules(no_broadcast, SF), ["event_id"]))
    joins = [line for line in text.splitlines() if "SortMergeJoin" in line and "slot" in line]
    assert joins and all("name" in line and "Inner" in line and ">=" not in line for line in joins)
    assert "NestedLoop" not in text and "Cartesian" not in text and "ObjectHashAggregate" not in text


@needs_tables
def test_overhead_reads_samples_once_and_aggregates_by_hash(no_broadcast):
    text = plan(queries.overhead(no_broadcast, SF))
    assert "SortAggregate" not in text and "Join" not in text and text.count("FileScan parquet") == 1
    trimmed = plan(queries.inner_samples(no_broadcast, SF))
    assert "SortAggregate" not in trimmed and "LeftAnti" not in trimmed
    for name in ("o_f10", "o_a21"):
        assert "SortAggregate" not in plan(queries.all_queries()[name](no_broadcast, SF)), name


def test_few_rules_out_of_a_large_source_reach_the_states_without_a_shuffle_of_slots(spark, monkeypatch):
    """States are shuffled once, into as many tasks as their pairs with rules ask for."""
    monkeypatch.setattr(policy, "PAIRS_A_TASK", 100)
    source = spark.range(20_000_000).select((F.col("id") % 3).alias("n")).distinct()     # looks large to Spark
    rules = source.select(F.concat(F.lit("r"), "n").alias("uid"), F.lit("property").alias("role"), F.lit("rssi").alias("name"),
                          F.lit(0.0).alias("lo"), F.col("n").cast("double").alias("hi"), F.lit(1.0).alias("score"))
    states = spark.range(400).select("id", (F.col("id") % 5).alias("rssi"))
    scores = policy.state_scores(states, rules, ["id"], ["rssi"])
    text = plan(scores)
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text
    assert re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)\), (\w+)", text) == [("id", "13", "REPARTITION_BY_NUM")]
    assert scores.groupBy("rules").agg(F.sum("score")).collect() == [(3, 480.0)]

"""The given tables cast in the roles of the measurement tables, by plain arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats.plans.campaign import Campaign
from linkstats.operators.enrich import with_span
from linkstats.sources.experiments import experiment_dimension

BATCH = "policy-3"
PROBE_EVENTS = ("click", "view", "purchase")
STATE_EVENTS = ("error", "signup")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.withColumns({"k": F.get_json_object("props", "$.k").cast("int"),
                          "ts": F.col("ts").cast("timestamp")})


def ids(source: str) -> list:
    key = F.col(source)
    return [(key % 15).cast("int").alias("exp_id"), key.cast("int").alias("sched_id"),
            (key % 7).cast("int").alias("node_id")]


def probes(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where(F.col("event_type").isin(*PROBE_EVENTS))
    iteration = (F.lit(1) + F.floor(F.col("event_id") / 2) % 5).cast("int")
    return e.select(
        "event_id", *ids("user_id"),
        F.when(F.col("event_id") % 2 == 0, "t-tcp-ping").otherwise("tcp-ping").alias("run_tool"),
        F.col("ts").alias("run_dtm"), iteration.alias("iter_nr"),
        F.concat(F.lit("op"), F.col("k") % 3).alias("if_name"),
        (F.lit(24000) + F.col("k") % 4).cast("int").alias("oper"),
        F.when(iteration == 1, "CONN").otherwise("ECHO").alias("ping_type"),
        (F.col("value") / 1000).alias("rtt"), "k")


def states(spark: SparkSession, sf: str) -> DataFrame:
    e = events(spark, sf).where(F.col("event_type").isin(*STATE_EVENTS))
    return e.select(
        "event_id", *ids("user_id"), F.col("event_id").alias("seq_no"), "ts",
        F.concat(F.lit("op"), F.col("k") % 3).alias("iif_name"),
        (F.col("k") % 6).cast("int").alias("dev_mode"),
        (-(F.lit(40) + F.col("k"))).cast("int").alias("rssi"),
        (-(F.col("k") % 15)).cast("int").alias("lte_rsrq"),
        (-(F.lit(80) + F.col("k") % 50)).cast("int").alias("lte_rsrp"), "k")


def downloads(spark: SparkSession, sf: str) -> DataFrame:
    l = table(spark, sf, "lineitem")
    part = F.col("l_partkey")
    return l.select(
        *ids("l_suppkey"),
        F.when(F.col("l_linestatus") == "O", "t-dwnl-test").otherwise("dwnl-test").alias("run_tool"),
        F.col("l_linenumber").alias("iter_nr"),
        F.concat(F.lit("op"), part % 2).alias("if_name"),
        (F.lit(24000) + part % 4).cast("int").alias("oper"),
        (F.col("l_quantity") * 1e6).cast("bigint").alias("dwnl_size"),
        F.col("l_discount").alias("init_time"),
        (F.col("l_discount") + F.col("l_extendedprice") / 10000).alias("total_time"),
        (part % 6).cast("int").alias("dev_mode"),
        (-(F.lit(40) + part % 100)).cast("int").alias("rssi"),
        (-(part % 15)).cast("int").alias("lte_rsrq"),
        (-(F.lit(80) + part % 50)).cast("int").alias("lte_rsrp"), "l_orderkey")


EXPERIMENTS = [(i, f"Day-{1 + i % 2}", f"2018-03-{15 + i:02d} 00:00", f"policy-{1 + i % 3}")
               for i in range(15)]


def experiments(spark: SparkSession) -> DataFrame:
    return experiment_dimension(spark, EXPERIMENTS)


def campaign(spark: SparkSession, sf: str, direct_mode: bool = False) -> Campaign:
    """Campaign over the roles. ``direct_mode`` takes a probe's mode from its own row
    (two thirds of the schedules then see other modes than LTE)."""
    pings = probes(spark, sf)
    if direct_mode:
        mode = F.when(F.col("sched_id") % 3 == 0, 5).otherwise(F.col("k") % 6).cast("int")
        unread = F.lit(None).cast("int")
        pings = pings.withColumns({"dev_mode": mode, "rssi": unread, "lte_rsrq": unread,
                                   "lte_rsrp": unread})
    return Campaign(experiments(spark), pings, downloads(spark, sf), with_span(states(spark, sf)), BATCH)

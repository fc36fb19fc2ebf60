"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The work follows a campaign's life: attach states and store the facts, store the
two summaries, then run reports on what is stored. Each time is the median of
three runs, after every query has run once to warm up the JVM.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3

REPORT_KEYS = ("q1", "q2", "q3", "q4", "q8", "q9", "q15", "q17", "q19", "n1", "n2")


def session() -> SparkSession:
    spark = (SparkSession.builder.master(f"local[{CPUS}]").appName("linkstats-bench")
             .config("spark.sql.shuffle.partitions", CPUS)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def consume(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(fn) -> float:
    seconds = []
    for _ in range(RUNS):
        start = time.perf_counter()
        fn()
        seconds.append(time.perf_counter() - start)
    return round(statistics.median(seconds), 3)


def main() -> None:
    from dataclasses import replace

    from pyspark.sql import functions as F

    from checks import roles
    from checks.queries import all_queries, write_raw_campaign
    from linkstats.operators.enrich import with_state
    from linkstats.plans import reports
    from linkstats.plans.load import load_campaign
    from linkstats.session import scratch_dir

    spark = session()
    queries = all_queries()
    steps = {}
    # From raw facts: as-of join, spans, resource samples, rules, flows and one stream in full.
    for name in ("q15", "q8", "r1", "o_j5", "o_w1", "o_j9", "o_a21", "o_t1"):
        steps[f"{name}_from_raw"] = lambda name=name: consume(queries[name](spark, SF_DIR))

    raw = roles.campaign(spark, SF_DIR)
    folder = scratch_dir(spark, "bench")

    # Result files of twenty schedules: small files, read, checked and published.
    write_raw_campaign(spark, SF_DIR, f"{folder}/raw", F.col("sched_id") < 20)
    steps["load_campaign"] = lambda: load_campaign(spark, f"{folder}/raw/config/*.txt", f"{folder}/raw", f"{folder}/loaded")

    def store_facts(target=f"{folder}/again"):
        with_state(raw.tcp_ping, raw.metadata).write.mode("overwrite").parquet(f"{target}/tcp_ping")
        raw.dwnl_test.write.mode("overwrite").parquet(f"{target}/dwnl_test")
        raw.metadata.write.mode("overwrite").parquet(f"{target}/metadata")

    steps["store_facts"] = store_facts
    store_facts(folder)
    facts = replace(raw, **{name: spark.read.parquet(f"{folder}/{name}")
                            for name in ("tcp_ping", "dwnl_test", "metadata")})
    steps["store_summaries"] = lambda: facts.with_stored_summaries(spark, f"{folder}/again")
    stored = facts.with_stored_summaries(spark, folder)
    for name in REPORT_KEYS:
        steps[name] = lambda name=name: consume(reports.run(name, stored))

    for step in steps.values():
        step()
    times = {name: timed(step) for name, step in steps.items()}
    print(json.dumps({"metric": "median seconds of headline queries, summed",
                      "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

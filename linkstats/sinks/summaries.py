"""Stored summaries that grow with each load.

A load adds its own parts, one row per schedule (``operators.summary``), and only the schedules it touches are
finished again, from their parts of all loads. Summaries lie in buckets of schedules; a bucket without a touched
schedule keeps its files. Parts and summaries are published together (``sinks.versions``): a load that fails
leaves the summaries as they were, and readers never see some of a load. A load that comes again under its name
replaces its parts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats.functions.measures import Arms
from linkstats.operators import summary
from linkstats.sinks.versions import Published, TableStore

LOAD, BUCKET = "load_id", "bucket"
KINDS: dict[str, tuple[Callable, Callable]] = {
    "ping_summary": (summary.ping_parts, summary.ping_summary_of_parts),
    "download_summary": (summary.download_parts, summary.download_summary_of_parts)}


@dataclass
class SummaryStore:
    spark: SparkSession
    root: str
    arms: Arms = field(default_factory=Arms)
    buckets: int = 64

    def _bucket(self):
        return F.pmod(F.xxhash64("sched_id"), F.lit(self.buckets)).cast("int")

    def _rows(self, published: Published, name: str, like: DataFrame) -> DataFrame:
        return published.table(self.spark, name) if name in published else like.limit(0)

    def add(self, load_name: str, **facts: DataFrame) -> Published:
        """Add a load's classified facts, given as ``ping_summary=...`` and ``download_summary=...``."""
        store = TableStore(self.spark, self.root)
        published = store.current()
        with store.load() as load:
            for name, frame in facts.items():
                parts_of, finish = KINDS[name]
                fresh = parts_of(frame, self.arms).withColumn(LOAD, F.lit(load_name))
                before = self._rows(published, f"{name}_parts", fresh)
                own = load.write(f"{name}_parts", fresh, [LOAD, "sched_id"], LOAD)
                replaced = before.where(F.col(LOAD) == load_name)
                touched = own.select("sched_id").union(replaced.select("sched_id")).distinct()
                others = before.where(F.col(LOAD) != load_name).join(touched, "sched_id", "left_semi")
                finished = finish(others.unionByName(own), self.arms).withColumn(BUCKET, self._bucket())
                stored = self._rows(published, name, finished)
                same_buckets = touched.select(self._bucket().alias(BUCKET)).distinct()
                kept = stored.join(same_buckets, BUCKET, "left_semi").join(touched, "sched_id", "left_anti")
                gone = [f"{BUCKET}={r[0]}" for r in same_buckets.collect()] if not replaced.isEmpty() else []
                load.replaces |= set(gone)  # also where nothing is left of a bucket
                load.write(name, finished.unionByName(kept), ["sched_id"], BUCKET)
        return load.published

    def read(self, name: str) -> DataFrame:
        return TableStore(self.spark, self.root).current().table(self.spark, name).drop(BUCKET)

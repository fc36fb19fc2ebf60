"""The latest row of each key of a stream, in a store of hash-bucketed delta files.

A batch writes the last row of each of its keys to a folder of its own, one sub-folder for each bucket it
touches, and then publishes the list of folders that hold (``sinks.versions.Manifests``). Other buckets are
not read or written. When a bucket has more than ``most_deltas`` folders, the batch merges them into one, so a
reader opens a bounded number. Readers resolve the newest list and keep seeing it while later batches write.

The list remembers the last batch of every query, by the id in its checkpoint. A batch that runs again after
it was published changes nothing; one that was cut short before leaves only folders that no list names. A
query with a fresh checkpoint has another id and adds to the store.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from linkstats.sinks.versions import Folder, Manifests
from linkstats.streaming.record_log import query_id

BUCKET = "bucket"


def latest_per_key(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by ``order``; of equal ones the greatest row."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    last = F.max(F.struct(*order, *rest))
    return (rows.groupBy(*keys).agg(last.alias("_last"))
            .select(*[F.col(c) if c in keys else F.col(f"_last.{c}").alias(c) for c in rows.columns]))


@dataclass(frozen=True)
class KeyedStore:
    path: str
    schema: T.StructType
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 64
    most_deltas: int = 8

    def _manifests(self, spark: SparkSession) -> Manifests:
        return Manifests(spark, f"{self.path}/_manifests")

    def _read(self, spark: SparkSession, folders: dict[str, list[str]]) -> DataFrame:
        paths = [f"{self.path}/data/{delta}/{bucket}" for bucket, deltas in sorted(folders.items()) for delta in deltas]
        if not paths:
            return spark.createDataFrame([], self._stored)
        return spark.read.schema(self._stored).option("basePath", f"{self.path}/data").parquet(*paths).select(
            *self._stored.names)

    @property
    def _stored(self) -> T.StructType:
        return T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])

    def _write(self, spark: SparkSession, rows: DataFrame, delta: str) -> list[str]:
        """Write rows by bucket; returns the names of the buckets written."""
        at = f"{self.path}/data/delta={delta}"
        rows.repartition(BUCKET).write.mode("overwrite").partitionBy(BUCKET).parquet(at)
        return [name for name, _ in Folder(spark, at).names() if name.startswith(f"{BUCKET}=")]

    def merge(self, batch: DataFrame, batch_id: int, query: str) -> None:
        """Take in a batch of the query ``query``."""
        spark, manifests = batch.sparkSession, self._manifests(batch.sparkSession)
        number, content = manifests.newest()
        if content.get("batches", {}).get(query, -1) >= batch_id:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        name = f"v{query}-{batch_id}"
        last = latest_per_key(batch.select(*self.schema.names), self.keys, self.order)
        touched = self._write(spark, last.withColumn(BUCKET, bucket), name)
        merged: dict[str, str] = {}
        while True:  # until no other query publishes in between
            folders = {b: list(deltas) for b, deltas in content.get("folders", {}).items()}
            for b in touched:
                folders[b] = [*folders.get(b, []), f"delta={name}"]
            full = {b: deltas for b, deltas in folders.items() if len(deltas) > self.most_deltas}
            if full:
                again = f"{name}-{number}"
                whole = latest_per_key(self._read(spark, full), (BUCKET, *self.keys), self.order)
                self._write(spark, whole.select(*self._stored.names), again)
                folders |= {b: [f"delta={again}"] for b in full}
            batches = content.get("batches", {}) | {query: batch_id}
            if manifests.publish(number + 1, {"batches": batches, "folders": folders}):
                return
            number, content = manifests.newest()

    def latest(self, spark: SparkSession) -> DataFrame:
        """The last row of each key, as of the newest published batch."""
        _, content = self._manifests(spark).newest()
        rows = self._read(spark, content.get("folders", {})).drop(BUCKET)
        return latest_per_key(rows, self.keys, self.order)

    def vacuum(self, spark: SparkSession, keep: int = 10) -> list[str]:
        """Remove lists but for the newest ``keep``, and delta folders of earlier batches that none of them names.
        Run it when no query writes."""
        kept = self._manifests(spark).forget(max(1, keep))
        used = {delta for content in kept for deltas in content["folders"].values() for delta in deltas}
        data = Folder(spark, f"{self.path}/data")
        gone = [name for name, _ in data.names() if name.startswith("delta=") and name not in used]
        for name in gone:
            data.remove(name)
        return gone


def start_latest(rows: DataFrame, store: KeyedStore, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep the latest row per key of a stream in a store."""
    def run(batch: DataFrame, batch_id: int) -> None:
        store.merge(batch, batch_id, query_id(batch))

    return (rows.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())

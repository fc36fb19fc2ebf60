"""Records of a stream in an append-only log that holds each of them once.

A batch writes its records to a folder of its own, named by the query's id and the batch number, and publishes
the new list of folders (``sinks.versions.Manifests``). A batch that runs again after that changes nothing, and
a query that lost its checkpoint gets another id, so it adds folders and overwrites none. A record that was
delivered twice that way, or sent twice, is told by its key: readers see the one that was delivered first.

Small folders are merged level by level: as soon as ``fan_in`` folders of a level are listed, the batch writes them
as one folder of the next level, without repeats. So a record is rewritten as often as the logarithm of the
number of batches, and the list stays short.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstats.sinks.versions import Folder, Manifests

DELIVERED = "delivered"  # number of the list that first named the record


def query_id(batch: DataFrame) -> str:
    """Id of the streaming query whose batch this is; it is kept in the checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")


@dataclass(frozen=True)
class RecordLog:
    path: str
    keys: tuple[str, ...] = ("if_name", "ts_epoch", "seq_no")
    fan_in: int = 8

    def _manifests(self, spark: SparkSession) -> Manifests:
        return Manifests(spark, f"{self.path}/_manifests")

    def _first(self, rows: DataFrame) -> DataFrame:
        """Of records with one key, the one delivered first; of those delivered at once, the least."""
        rest = [c for c in rows.columns if c not in self.keys and c != DELIVERED]
        least = F.min(F.struct(DELIVERED, *rest))
        return rows.groupBy(*self.keys).agg(least.alias("_least")).select(
            *[F.col(c) if c in self.keys else F.col(f"_least.{c}").alias(c) for c in rows.columns])

    def _read(self, spark: SparkSession, names: list[str], schema: T.StructType) -> DataFrame:
        return spark.read.schema(schema).parquet(*[f"{self.path}/data/{name}" for name in names])

    def deliver(self, rows: DataFrame, batch_id: int, query: str | None = None) -> None:
        """Take in a batch; ``query`` is the id of the query that runs it."""
        spark, query = rows.sparkSession, query or query_id(rows)
        manifests = self._manifests(spark)
        number, content = manifests.newest()
        if content.get("batches", {}).get(query, -1) >= batch_id:
            return
        name = f"{query}-{batch_id}"
        numbered = rows.withColumn(DELIVERED, F.lit(number + 1).cast("bigint"))
        numbered.write.mode("overwrite").parquet(f"{self.path}/data/{name}")
        while True:  # until no other query publishes in between
            levels = {int(level): list(names) for level, names in content.get("levels", {}).items()}
            levels.setdefault(0, []).append(name)
            level = 0
            while len(levels.get(level, [])) >= self.fan_in:
                merged = f"{name}-{number}-{level + 1}"
                whole = self._first(self._read(spark, levels.pop(level), numbered.schema))
                whole.write.mode("overwrite").parquet(f"{self.path}/data/{merged}")
                level += 1
                levels.setdefault(level, []).append(merged)
            if manifests.publish(number + 1, {"batches": content.get("batches", {}) | {query: batch_id},
                                              "levels": levels, "schema": numbered.schema.jsonValue()}):
                return
            number, content = manifests.newest()

    __call__ = deliver

    def read(self, spark: SparkSession) -> DataFrame | None:
        """Each record once, as of the newest list; None before the first batch."""
        _, content = self._manifests(spark).newest()
        if not content:
            return None
        schema = T.StructType.fromJson(content["schema"])
        names = [name for level in content["levels"].values() for name in level]
        return self._first(self._read(spark, names, schema)).drop(DELIVERED)

    def vacuum(self, spark: SparkSession, keep: int = 10) -> list[str]:
        """Remove lists but for the newest ``keep``, and folders that none of them names. Run it when no query writes."""
        used = {name for content in self._manifests(spark).forget(max(1, keep)) for level in content["levels"].values()
                for name in level}
        data = Folder(spark, f"{self.path}/data")
        gone = [name for name, _ in data.names() if name not in used]
        for name in gone:
            data.remove(name)
        return gone

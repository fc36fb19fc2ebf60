"""Experiment configs and the experiment dimension."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats import schemas


def parse_experiment_configs(documents: DataFrame, value: str = "value") -> DataFrame:
    """(exp_id, sched_id, node_id) of every schedule in the JSON documents."""
    config = F.from_json(value, schemas.EXPERIMENT_CONFIG, {"mode": "FAILFAST"})
    return (documents.select(config.alias("c"))
            .select(F.col("c.id").alias("exp_id"), F.explode("c.schedules").alias("sched", "entry"))
            .select("exp_id", F.col("sched").cast("int").alias("sched_id"),
                    F.col("entry.nodeid").alias("node_id")))


def read_experiment_configs(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file; any number of files."""
    return parse_experiment_configs(spark.read.text(path, wholetext=True))


def experiment_dimension(spark: SparkSession, rows: Iterable[tuple[int, str, str, str]]) -> DataFrame:
    """Dimension from inline (exp_id, exp_name, 'yyyy-MM-dd HH:mm', batch) rows.

    The rows are part of the plan, so Spark knows their size when it picks a join.
    """
    names = ("exp_id", "exp_name", "exp_dtm", "batch")
    columns = list(zip(*rows)) or [()] * len(names)
    raw = spark.createDataFrame(pa.table({
        name: pa.array(list(values), pa.int32() if name == "exp_id" else pa.string())
        for name, values in zip(names, columns)}))
    return raw.withColumn("exp_dtm", F.to_timestamp("exp_dtm", "yyyy-MM-dd HH:mm"))


def of_batch(facts: DataFrame, experiments: DataFrame, batch: str) -> DataFrame:
    """Facts of the experiments in one batch, unchanged otherwise."""
    chosen = experiments.where(F.col("batch") == batch).select("exp_id")
    return facts.join(chosen, "exp_id", "left_semi")


def with_experiment(facts: DataFrame, experiments: DataFrame, batch: str | None = None) -> DataFrame:
    """Left join with the dimension; a batch filter on the right side makes it inner."""
    joined = facts.join(experiments, "exp_id", "left")
    return joined if batch is None else joined.where(F.col("batch") == batch)

"""Probe rows: tab-separated lines without header. A malformed row fails the read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstats import schemas
from linkstats.sources.files import (
    DOWNLOAD_GLOB, DOWNLOAD_NAME, PING_GLOB, PING_NAME, Root, read_result_lines, shared_listing)

TSV = {"sep": "\t", "quote": ""}


def read_tsv(spark: SparkSession, path: str | list[str], schema: T.StructType, glob: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema).options(**TSV).option("mode", "FAILFAST").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    with shared_listing(spark):
        return reader.csv(path)


def parse_runs(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    """Lines as the columns of ``schema``; blank lines are skipped, as Spark's CSV reader skips them."""
    has_text = F.col(value).rlike(r"[^\x00-\x20]")
    # As for metadata lines, blank lines must not reach the parser in any order.
    row = F.when(has_text, F.from_csv(value, schema.simpleString(), TSV | {"mode": "FAILFAST"}))
    rows = lines.where(has_text).withColumn("_row", row).drop(value)
    return rows.select("_row.*", *[c for c in rows.columns if c != "_row"])


def _read_runs(spark: SparkSession, root: Root, schema: T.StructType, name: str, glob: str) -> DataFrame:
    return parse_runs(read_result_lines(spark, root, name, glob), schema).drop("path")


def read_pings(spark: SparkSession, root: Root, name: str = PING_NAME, glob: str = PING_GLOB) -> DataFrame:
    return _read_runs(spark, root, schemas.PING_TSV, name, glob)


def read_downloads(spark: SparkSession, root: Root, name: str = DOWNLOAD_NAME, glob: str = DOWNLOAD_GLOB) -> DataFrame:
    return _read_runs(spark, root, schemas.DOWNLOAD_TSV, name, glob)

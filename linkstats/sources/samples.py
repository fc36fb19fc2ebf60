"""Resource samples: one header line, then one row per sampling period."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkstats import schemas


def _scan(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.schema(schemas.SAMPLE_TSV).option("sep", "\t").option("quote", "")
            .option("header", True).option("nullValue", "None").option("mode", "FAILFAST")
            .option("recursiveFileLookup", True).csv(path))


def split_offsets(scan: DataFrame) -> DataFrame:
    """(recording, split, before): rows of a file that come before each of its splits."""
    counts = scan.groupBy(F.col("_metadata.file_path").alias("recording"),
                          F.col("_metadata.file_block_start").alias("split")).agg(F.count("*").alias("rows"))
    earlier = Window.partitionBy("recording").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("recording", "split", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Wide samples with ``recording`` (the file) and ``line_no``, from 1 in it.

    The clock text of a sample wraps at midnight, so the order within a recording is the order of
    lines. Files are read in splits: a first pass counts the rows of each split, and a row's number
    is its place in its split after all rows of the splits before. That place follows from the order
    of reading within the split, so numbers are the same however files are split and dealt to tasks,
    and no task holds more than a split.
    """
    scan = _scan(spark, path)
    rows = scan.select(F.col("_metadata.file_path").alias("recording"), F.col("_metadata.file_block_start").alias("split"),
                       F.monotonically_increasing_id().alias("read_as"), "*")
    in_split = Window.partitionBy("recording", "split").orderBy("read_as")
    placed = rows.withColumn("place", F.row_number().over(in_split)).join(split_offsets(scan), ["recording", "split"])
    return placed.select("recording", (F.col("place") + F.col("before")).alias("line_no"), *schemas.SAMPLE_TSV.names)

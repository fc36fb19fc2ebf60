"""Tables and views."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats.functions.measures import fixed_point


def replace_table(df: DataFrame, name: str, path: str) -> DataFrame:
    """Store a frame as a table of the catalog; returns it as read from storage.

    The rows are written to a new folder below ``path`` first. Only then is the table, if there is
    one, pointed there, so a write that fails leaves it as it was. Folders of earlier versions stay.
    """
    spark, version = df.sparkSession, f"{path}/version={uuid.uuid4().hex}"
    df.write.parquet(version)
    back = spark.read.schema(df.schema).parquet(version)
    if spark.catalog.tableExists(name) and spark.table(name).schema.simpleString() == back.schema.simpleString():
        spark.sql(f"ALTER TABLE {name} SET LOCATION '{version}'")
        spark.catalog.refreshTable(name)
    else:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        spark.catalog.createTable(name, version, "parquet", df.schema)
    return spark.table(name)


def replace_views(spark: SparkSession, views: dict[str, DataFrame]) -> None:
    for name, frame in views.items():
        frame.createOrReplaceTempView(name)


def report_lines(report: DataFrame, columns: Sequence[str], decimals: int = 6) -> DataFrame:
    """One tab-separated text line per row; doubles in fixed-point form."""
    kinds = dict(report.dtypes)

    def text(name: str) -> Column:
        return fixed_point(name, decimals) if kinds[name] == "double" else F.col(name).cast("string")

    return report.select(F.concat_ws("\t", *[F.coalesce(text(c), F.lit("")) for c in columns]).alias("value"))


def write_report(report: DataFrame, columns: Sequence[str], path: str, decimals: int = 6) -> None:
    report_lines(report, columns, decimals).write.mode("overwrite").text(path)

"""Topic messages ``<topic> <json>``: split, parse, and set bad ones aside.

The functions work on batch and streaming DataFrames alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstats import schemas
from linkstats.functions.records import STREAM_WIDTHS, narrow

CORRUPT = "_corrupt_record"


def subscribe(spark: SparkSession, servers: str, topic: str, **options: str) -> DataFrame:
    """Kafka stream of messages as ``value`` text; needs the Kafka package on the classpath."""
    return (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", topic).options(**options).load()
            .select(F.col("value").cast("string").alias("value")))


def follow_files(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """File stream of one message per line."""
    return spark.readStream.options(**options).text(path)


def split_messages(messages: DataFrame, topic: str = "", value: str = "value") -> DataFrame:
    """Messages under a topic prefix as ``header`` and ``body``.

    Both are NULL for a message without a space; such messages are rejected.
    """
    raw = F.col(value)
    space = F.instr(raw, " ")
    return messages.where(raw.startswith(topic)).withColumns({
        "header": F.when(space > 0, F.substring(raw, F.lit(1), space - 1)),
        "body": F.when(space > 0, F.substring(raw, space + 1, F.length(raw)))})


def _parsed() -> Column:
    schema = T.StructType(schemas.METADATA_JSON.fields + [T.StructField(CORRUPT, T.StringType())])
    return F.from_json("body", schema,
                       {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})


def parse_messages(split: DataFrame, interface_key: str = "InterfaceName",
                   narrowing: str = "wrap") -> DataFrame:
    """Typed message columns under the stream's defaults, plus ``rejected``.

    A missing number is 0 and missing text is empty. ``rejected`` names what is
    wrong with a message; rejected rows have NULL in the message columns.
    """
    rows = split.withColumn("_m", _parsed())
    rejected = (F.when(F.col("body").isNull(), "no space")
                .when(F.col(f"_m.{CORRUPT}").isNotNull(), "bad json"))
    rows = rows.withColumn("rejected", rejected)
    good = F.col("rejected").isNull()
    columns = {}
    for key, name, kind in schemas.METADATA_KEYS:
        field = F.col(f"_m.{key}")
        if name == "iif_name":
            continue
        if name == "if_name":
            columns["dlb_if_name"] = F.when(good, F.coalesce(field, F.lit("")))
            field = F.col(f"_m.{interface_key}")
        if name == "ts_epoch":
            columns[name] = F.when(good, F.coalesce(field, F.lit(0.0)))
        elif kind.typeName() == "string":
            columns[name] = F.when(good, F.coalesce(field, F.lit("")))
        else:
            number = F.coalesce(field, F.lit(0))
            if name in STREAM_WIDTHS:
                bits, signed = STREAM_WIDTHS[name]
                number = narrow(number, bits, signed, narrowing)
            columns[name] = F.when(good, number)
    return rows.withColumns(columns).drop("_m")


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.where("rejected IS NULL").drop("rejected")


def rejects(parsed: DataFrame) -> DataFrame:
    return parsed.where("rejected IS NOT NULL").select("value", "rejected")

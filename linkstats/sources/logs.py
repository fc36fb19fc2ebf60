"""Free-text logs: address lines of the policy daemon, JSON lines of the modem log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats import schemas
from linkstats.functions.times import epoch_timestamp
from linkstats.sources.files import METADATA_NAME, POLICY_LOG_NAME, Root, read_result_lines

# How a log line names an address and its interface.
LOCAL_IP = r"\[local_ip\|(\d+[.]\d+[.]\d+[.]\d+)\]"
INTERFACE = r"\[interface\|(\w+)\]"


def parse_address_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines that name both an address and an interface, as two columns."""
    found = lines.withColumns({
        "local_ip": F.regexp_extract(value, LOCAL_IP, 1),
        "if_name": F.regexp_extract(value, INTERFACE, 1)})
    return found.where((F.col("local_ip") != "") & (F.col("if_name") != "")).drop(value)


def read_policy_log(spark: SparkSession, root: Root, name: str = POLICY_LOG_NAME,
                    glob: str | None = None) -> DataFrame:
    lines = read_result_lines(spark, root, name, glob or f"{name}-*.txt*")
    return parse_address_lines(lines).drop("path", "run_dtm")


def _mandatory(record: Column, key: str) -> Column:
    problem = F.lit(f"{key} is missing in a metadata line")
    missing = F.raise_error(problem).cast(schemas.METADATA_JSON[key].dataType)
    return F.when(record.isNotNull(), F.coalesce(record[key], missing))


def parse_metadata_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON lines of a modem log as typed columns; a missing key is NULL.

    Lines not starting with ``{`` are skipped. Malformed JSON and a missing
    interface or timestamp fail the read.
    """
    is_json = F.col(value).startswith("{")
    # Spark may test a condition on the parsed columns before the line filter, so
    # other lines must not reach the parser in any order.
    record = F.when(is_json, F.from_json(value, schemas.METADATA_JSON, {"mode": "FAILFAST"}))
    rows = lines.where(is_json).withColumn("_record", record).drop(value)
    columns = {}
    for key, name, _ in schemas.METADATA_KEYS:
        if name == "ts_epoch":
            columns["ts"] = epoch_timestamp(_mandatory(F.col("_record"), key))
        elif name == "iif_name":
            columns[name] = _mandatory(F.col("_record"), key)
        else:
            columns[name] = F.col("_record")[key]
    return rows.withColumns(columns).drop("_record")


def read_metadata_log(spark: SparkSession, root: Root, name: str = METADATA_NAME,
                      glob: str | None = None) -> DataFrame:
    lines = read_result_lines(spark, root, name, glob or f"{name}-*.txt*")
    return parse_metadata_lines(lines).drop("path", "run_dtm")

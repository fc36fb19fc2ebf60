"""Run configs: one flat JSON object per file; malformed files are kept aside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstats import schemas

CORRUPT = "_corrupt_record"


def parse_run_configs(documents: DataFrame, value: str = "value") -> DataFrame:
    """Typed config columns; ``run_commands`` split to an array.

    A document that is no valid config has its text in ``_corrupt_record`` and
    NULL everywhere else.
    """
    schema = T.StructType(schemas.RUN_CONFIG.fields + [T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(value, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    kept = [name for name in documents.columns if name != value]
    rows = documents.select(*kept, parsed.alias("c"))
    columns = [F.when(F.col(f"c.{CORRUPT}").isNull(), F.col(f"c.{f.name}")).alias(f.name)
               for f in schemas.RUN_CONFIG.fields]
    return (rows.select(*kept, *columns, F.col(f"c.{CORRUPT}").alias(CORRUPT))
            .withColumn("run_commands", F.split(F.trim("run_commands"), r"\s+")))


def read_run_configs(spark: SparkSession, path: str) -> DataFrame:
    documents = (spark.read.text(path, wholetext=True)
                 .select(F.col("_metadata.file_path").alias("path"), "value"))
    return parse_run_configs(documents)

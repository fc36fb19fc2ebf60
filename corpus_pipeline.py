"""A corpus pipeline: every stage takes what the one before it kept and writes it as Parquet.

1. toxicity: documents scored toxic go.
2. line dedup: repeated lines go, documents stay.
3. near dedup: of every group of near copies (five-word shingles, similarity 0.8) one document stays.
4. decontamination: documents that hold a benchmark item go.
5. mixing: every document gets its domain posterior and its rate for the target weights.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkstats.llm.common import table
from linkstats.llm.decontaminate import decontaminated
from linkstats.llm.line_dedup import dedup_lines
from linkstats.llm.mixing import MIXTURE, mix
from linkstats.llm.near_dedup import one_of_each
from linkstats.llm.toxicity import fit_toxicity, toxicity_score
from linkstats.session import scratch_dir


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity_score(F.col("text"), model) < 0.5)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = dedup_lines(docs)
    return kept.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs, words=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, table(spark, sf_dir, "labels"), MIXTURE)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("near dedup", near_dedup),
          ("decontamination", decontamination), ("mixing", mixing)]

#: SQL cannot express the learned stages; the tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_dir(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

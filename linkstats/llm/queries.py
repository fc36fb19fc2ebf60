"""One query per corpus operator over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from linkstats.llm import oracle
from linkstats.llm.common import held_out, table
from linkstats.llm.conversation_trie import conversation_trie
from linkstats.llm.decontaminate import find_matches
from linkstats.llm.hard_negatives import hard_negatives
from linkstats.llm.language import fit_language, predict_language
from linkstats.llm.line_dedup import dedup_lines
from linkstats.llm.mixing import MIXTURE, mix
from linkstats.llm.near_dedup import near_duplicates
from linkstats.llm.quality import quality
from linkstats.llm.simhash import near_duplicates as simhash_duplicates
from linkstats.llm.suffix_dedup import remove_repeats
from linkstats.llm.toxicity import fit_toxicity, score_toxicity
from linkstats.llm.vector_search import nearest
from linkstats.llm.warc import page_of, read_warc, records, write_warc
from linkstats.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = predict_language(docs, fit_language(docs), spans=False)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped",
                                    F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return records(read_warc(spark, folder, payloads=False)).select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest",
        F.col("warc_type").alias("record_type"), page_of(F.col("refers_to")).alias("refers_to"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), depth=400).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents").select("doc_id", "text"),
                        table(spark, sf_dir, "benchmark"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mix(docs, table(spark, sf_dir, "labels"), MIXTURE)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                                              "predicted")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", shifted.alias("label"), "embedding")
    return hard_negatives(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=5)


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, bits=3)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = F.col("conv_id")
    return conversation_trie(table(spark, sf_dir, "conversations"), base=conv - conv % 20,
                             head=F.crc32(conv.cast("string")) % 4, most_head=3)


def all_queries() -> dict[str, Query]:
    return {q.__name__: q for q in (
        op1_near_dedup, op2_vector_search, op3_language, op4_line_dedup, op5_warc, op6_suffix_dedup, op7_decontamination, op8_mixing,
        op9_quality, op10_toxicity,
        op11_hard_negatives, op12_simhash, op13_conversation_trie)} | {"pipeline": corpus_pipeline.run}


def all_sql() -> dict[str, str]:
    return dict(oracle.SQL)

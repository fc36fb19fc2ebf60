"""Reshape topic messages into interface records, with link quality looked up."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from linkstats.functions.records import RecordLayout, interface_record
from linkstats.sources.topic import accepted, parse_messages, rejects, split_messages
from linkstats.streaming.record_log import query_id


def parsed_messages(messages: DataFrame, topic: str = "", interface_key: str = "InterfaceName",
                    narrowing: str = "wrap") -> DataFrame:
    return parse_messages(split_messages(messages, topic), interface_key, narrowing)


def with_link_quality(messages: DataFrame, quality: DataFrame) -> DataFrame:
    """Left join with (name, conn, quality) by interface name; a miss is NULL."""
    side = quality.select(F.col("name").alias("dlb_if_name"), F.col("conn").alias("dlb_conn"),
                          F.col("quality").alias("dlb_quality"))
    return messages.join(side, "dlb_if_name", "left")


def records(messages: DataFrame, layout: RecordLayout = RecordLayout()) -> DataFrame:
    """(if_name, ts_epoch, seq_no, record) with the record as JSON text."""
    known = "dlb_conn" in messages.columns
    record = interface_record("if_name", "dlb_conn" if known else None,
                              "dlb_quality" if known else None, layout)
    return messages.select("if_name", "ts_epoch", "seq_no", F.to_json(record).alias("record"))


Delivery = Callable[[DataFrame, int], None]


def to_folder(path: str) -> Delivery:
    """Write each batch to a folder of its query and number; a replayed batch replaces what it wrote. For one
    record each, whatever is sent or delivered twice, give a ``RecordLog`` instead."""
    def deliver(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/query={query_id(rows)}/batch={batch_id}")
    return deliver


def without_repeats(parsed: DataFrame, within: str) -> DataFrame:
    """A stream of parsed messages without those that came before within a time of arrival. A good message is told
    by interface, time and sequence number, a bad one by its text."""
    told_by = F.when(F.col("rejected").isNull(), F.to_json(F.struct("if_name", "ts_epoch", "seq_no"))).otherwise(F.col("value"))
    return (parsed.withColumns({"_told_by": told_by, "_arrived": F.current_timestamp()}).withWatermark("_arrived", within)
            .dropDuplicatesWithinWatermark(["_told_by"]).drop("_told_by", "_arrived"))


def to_kafka(servers: str, topic: str) -> Delivery:
    """Send each record to a topic, keyed by interface. Needs the Kafka package; a
    replayed batch is sent again."""
    def deliver(rows: DataFrame, batch_id: int) -> None:
        (rows.select(F.col("if_name").alias("key"), F.col("record").alias("value")).write
         .format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save())
    return deliver


def start_records(messages: DataFrame, deliver: Delivery | None, rejected: Delivery, checkpoint: str,
                  topic: str = "", interface_key: str = "InterfaceName", narrowing: str = "wrap",
                  load_quality: Callable[[], DataFrame] | None = None,
                  layout: RecordLayout = RecordLayout(), trigger: dict | None = None,
                  repeats_within: str | None = None) -> StreamingQuery:
    """Run the message path: good messages become records, bad ones are set aside.

    ``load_quality`` is called per batch and so refreshes the lookup as often as
    the trigger fires. Without ``deliver`` no consumer is configured and records
    are dropped. With ``repeats_within``, like "1 hour", messages that arrive again within
    that time are left out.
    """
    parsed_stream = parsed_messages(messages, topic, interface_key, narrowing)
    if repeats_within is not None:
        parsed_stream = without_repeats(parsed_stream, repeats_within)

    def run(batch: DataFrame, batch_id: int) -> None:
        # Both outputs read the batch; it is parsed once for them.
        parsed = batch.persist()
        try:
            rejected(rejects(parsed), batch_id)
            if deliver is None:
                return
            good = accepted(parsed)
            if load_quality is not None:
                good = with_link_quality(good, load_quality())
            deliver(records(good, layout), batch_id)
        finally:
            parsed.unpersist()

    return (parsed_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "5 seconds"})).start())

"""Transfer statistics of flows: summaries and interval rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstats.functions.measures import human_size, protocol_name, ratio
from linkstats.functions.times import MICROS, elapsed_seconds, micros
from linkstats.operators.slices import SLICE_SECONDS, place_of, with_neighbour


def flow_summary(reads: DataFrame, flow: str = "flow_id", ts: str = "ts",
                 tiebreak: Sequence[str] = ()) -> DataFrame:
    """Bytes, reads, duration, bandwidth and last protocol of each flow.

    A flow of one instant has no bandwidth.
    """
    place = place_of(reads, [ts, *(tiebreak or ["protocol"])])
    sums = reads.groupBy(flow).agg(
        F.sum("bytes").alias("bytes"), F.count("*").alias("reads"),
        F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.max_by("protocol", place).alias("_last"))
    timed = sums.withColumn("duration", elapsed_seconds("first_ts", "last_ts"))
    timed = timed.withColumn("bandwidth", ratio(F.col("bytes") * 8, "duration"))
    return timed.withColumns({
        "protocol": protocol_name("_last"),
        "size_text": human_size("bytes"),
        "bandwidth_text": F.concat(human_size("bandwidth"), F.lit("it/s"))}).drop("_last")


def interval_rate(reads: DataFrame, flow: str = "flow_id", ts: str = "ts", counter: str = "bytes_total",
                  tiebreak: Sequence[str] = (), seconds: int = SLICE_SECONDS) -> DataFrame:
    """Bits per second since the previous reading of a growing byte counter.

    The first reading of a flow, and one at the same instant, has no rate.
    """
    linked = with_neighbour(reads, [flow], ts, {"_ts": micros(ts), "_count": F.col(counter)},
                            "previous", tiebreak, seconds)
    grown = F.col(counter) - F.col("_count")
    passed = (micros(ts) - F.col("_ts")) / F.lit(float(MICROS))
    return (linked.withColumns({"interval_bytes": grown, "interval_seconds": passed,
                                "rate_bps": ratio(grown * 8, passed)}).drop("_ts", "_count"))

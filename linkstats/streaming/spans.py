"""Spans of streamed states: each state lasts until the next one of its key.

States may arrive out of order by up to ``delay``. A key keeps the states it cannot place yet: those behind
the watermark are in their final order, so each gets its span from the one that follows it, and the last of
them stays open until a follower is behind the watermark as well. Timers at event times close states of keys
that get no more input. A state older than the watermark on arrival comes too late to be placed; it is given
out without a span and marked late, for a batch recomputation.

Only keys with input or a timer that fires are touched by a batch. The states of one key wait in one task:
those of ``delay`` and of the batch, so bound a batch of a busy source (``maxFilesPerTrigger``).

The state store must be RocksDB, as ``transformWithState`` asks; ``start_spans`` sets it for its own query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from linkstats.functions.times import micros

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MICROS_A_MILLI = 1000


class SpanProcessor(StatefulProcessor):
    """Rows (keys, at, rest) to rows (keys, at, rest, next_at, late). ``at`` is in microseconds."""

    def __init__(self, keys: Sequence[str], order: Sequence[str], waiting: T.StructType):
        self.keys, self.order, self.waiting = list(keys), list(order), waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.states = handle.getListState("waiting", self.waiting)

    def _place(self, key: tuple, rows: list[tuple], watermark: int) -> Iterator[Row]:
        """Give out states whose follower is behind the watermark; keep the others."""
        if not rows:  # all that came is late: nothing waits, and no timer is set; a list state cannot hold an empty list
            return
        at = [self.waiting.names.index(c) for c in self.order]
        rows.sort(key=lambda r: tuple((r[i] is not None, r[i]) for i in at))
        settled = sum(r[at[0]] < watermark for r in rows)
        names = [*self.keys, *self.waiting.names, "next_at", "late"]
        for one, follower in zip(rows[:settled], rows[1:settled]):
            yield Row(**dict(zip(names, (*key, *one, follower[at[0]], False))))
        rest = rows[max(0, settled - 1):]
        self.states.put([tuple(r) for r in rest])
        ahead = [r[at[0]] for r in rows[settled:]]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if ahead:  # the first of them will close what is open, if anything is, and settle
            self.handle.registerTimer(min(ahead) // MICROS_A_MILLI + 1)

    def _waiting(self) -> list[tuple]:
        return list(self.states.get()) if self.states.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * MICROS_A_MILLI
        first, held = self.order[0], self._waiting()
        for row in rows:
            if row[first] is None or row[first] < watermark:
                yield Row(**dict(zip([*self.keys, *self.waiting.names, "next_at", "late"],
                                     (*key, *(row[c] for c in self.waiting.names), None, True))))
            else:
                held.append(tuple(row[c] for c in self.waiting.names))
        yield from self._place(key, held, watermark)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._place(key, self._waiting(), timerValues.getCurrentWatermarkInMs() * MICROS_A_MILLI)

    def close(self) -> None:
        pass


def streamed_spans(rows: DataFrame, keys: Sequence[str], ts: str, delay: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Stream of ``rows`` with ``span`` (seconds to the next state of the key) and ``late`` (0 or 1). A late row has
    no span."""
    rest = [c for c in rows.columns if c not in keys and c != ts]
    # The processor sees the time as a plain number, so Spark does not drop late rows before it.
    timed = rows.withWatermark(ts, delay).withColumn("at", micros(ts)).select(*keys, "at", *rest)
    waiting = T.StructType([timed.schema[c] for c in ("at", *rest)])
    out = T.StructType([*(timed.schema[c] for c in keys), *waiting.fields,
                        T.StructField("next_at", T.LongType()), T.StructField("late", T.BooleanType())])
    placed = timed.groupBy(*keys).transformWithState(
        SpanProcessor(keys, ["at", *tiebreak], waiting), out, outputMode="Append", timeMode="EventTime")
    return placed.select(
        *[F.timestamp_micros("at").alias(ts) if c == ts else F.col(c) for c in rows.columns],
        ((F.col("next_at") - F.col("at")) / F.lit(1e6)).alias("span"), F.col("late").cast("int").alias("late"))


def with_rocksdb(spark: SparkSession, start: Callable[[], StreamingQuery]) -> StreamingQuery:
    """Start a query with the state store it needs. A query keeps the settings it was started with."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return start()
    finally:
        spark.conf.set(PROVIDER, before) if before else spark.conf.unset(PROVIDER)


def start_spans(rows: DataFrame, output: str, keys: Sequence[str], ts: str, checkpoint: str,
                delay: str = "1 minute", tiebreak: Sequence[str] = (), trigger: dict | None = None) -> StreamingQuery:
    """Append each state with its span to Parquet, once, when its follower is certain; late ones apart (``late=1``)."""
    return with_rocksdb(rows.sparkSession, lambda: (
        streamed_spans(rows, keys, ts, delay, tiebreak).writeStream.outputMode("append").partitionBy("late")
        .format("parquet").option("path", output).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "5 seconds"})).start()))


def waiting_states(rows: DataFrame, checkpoint: str, ts: str) -> DataFrame:
    """States that a stopped query still keeps, read from its checkpoint: what is open, and what is newer than the
    watermark."""
    spark = rows.sparkSession
    kept = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "waiting")
            .option("flattenCollectionTypes", True).load().select("key.*", "list_element.*"))
    return kept.select(*[F.timestamp_micros("at").alias(ts) if c == ts else F.col(c) for c in rows.columns])

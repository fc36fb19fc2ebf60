"""Tumbling-window means over a stream of resource samples.

Each window and key keeps a count and a sum per value. When the watermark passes the end of a window, its sums
are written. A sample that comes after that is not dropped: its part is written apart (``late=1``), and
``corrected_windows`` adds it to the window. Windows that are still open when a query stops are read from its
checkpoint, so written, late and open parts make up the same windows as a batch over all samples.

A batch touches only windows with input and those that end. The state store must be RocksDB, as
``transformWithStateInPandas`` asks; ``start_window_parts`` sets it for its own query.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from linkstats.functions.measures import ratio
from linkstats.functions.times import micros
from linkstats.streaming.spans import MICROS_A_MILLI, with_rocksdb

WRITTEN, CORRECTED, OPEN = "written", "corrected", "open"


def window_means(samples: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts",
                 width: str = "1 minute") -> DataFrame:
    """Mean and count per key and window of a table."""
    means = [c for name in values for c in (F.count(name).alias(f"{name}_cnt"),
                                            F.avg(name).alias(f"{name}_avr"))]
    return (samples.groupBy(F.window(ts, width), *keys).agg(*means)
            .select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                    *keys, *[c for name in values for c in (f"{name}_cnt", f"{name}_avr")]))


def _sums(values: Sequence[str]) -> list[T.StructField]:
    return [f for name in values for f in (T.StructField(f"{name}_cnt", T.LongType()), T.StructField(f"{name}_sum", T.DoubleType()))]


class WindowProcessor(StatefulProcessor):
    """Samples of a key (begin, end, keys; times in microseconds) to parts of its window."""

    def __init__(self, keys: Sequence[str], values: Sequence[str]):
        self.keys, self.values = ["begin", "end", *keys], list(values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.sums = handle.getValueState("sums", T.StructType(_sums(self.values)))

    def _part(self, key: tuple, sums: Sequence, late: int) -> pd.DataFrame:
        names = [*self.keys, *(f.name for f in _sums(self.values)), "late"]
        return pd.DataFrame({n: [v] for n, v in zip(names, (*key, *sums, late))})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums = [0, 0.0] * len(self.values)
        for frame in rows:
            for i, name in enumerate(self.values):
                sums[2 * i] += int(frame[name].count())
                sums[2 * i + 1] += float(frame[name].sum())
        if key[1] <= timerValues.getCurrentWatermarkInMs() * MICROS_A_MILLI:
            yield self._part(key, sums, 1)
        elif self.sums.exists():
            self.sums.update(tuple(a + b for a, b in zip(self.sums.get(), sums)))
        else:
            self.sums.update(tuple(sums))
            self.handle.registerTimer(key[1] // MICROS_A_MILLI)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.sums.exists():
            yield self._part(key, self.sums.get(), 0)
            self.sums.clear()

    def close(self) -> None:
        pass


def window_parts(samples: DataFrame, keys: Sequence[str], values: Sequence[str], ts: str = "ts",
                 width: str = "1 minute", delay: str = "1 minute") -> DataFrame:
    """Stream of window parts: (window_start, window_end, keys, <value>_cnt and <value>_sum of each value, late)."""
    # The processor sees plain numbers for times, so Spark does not drop late samples before it.
    timed = samples.withWatermark(ts, delay).withColumn("_window", F.window(F.timestamp_micros(micros(ts)), width)).select(
        micros("_window.start").alias("begin"), micros("_window.end").alias("end"), *keys,
        *[F.col(v).cast("double").alias(v) for v in values])
    out = T.StructType([*(timed.schema[c] for c in ("begin", "end", *keys)), *_sums(values), T.StructField("late", T.IntegerType())])
    parts = timed.groupBy("begin", "end", *keys).transformWithStateInPandas(
        WindowProcessor(keys, values), out, outputMode="Append", timeMode="EventTime")
    return _timed(parts, keys, values, "late")


def _timed(parts: DataFrame, keys: Sequence[str], values: Sequence[str], *more: str) -> DataFrame:
    return parts.select(F.timestamp_micros("begin").alias("window_start"), F.timestamp_micros("end").alias("window_end"),
                        *keys, *[f.name for f in _sums(values)], *more)


def start_window_parts(parts: DataFrame, output: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append the sums of every window to Parquet once the watermark has passed its end, and late parts apart."""
    return with_rocksdb(parts.sparkSession, lambda: (
        parts.writeStream.outputMode("append").partitionBy("late").format("parquet").option("path", output)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "1 minute"})).start()))


def open_windows(spark, checkpoint: str, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Sums of the windows that a stopped query has not written yet."""
    kept = (spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "sums").load()
            .select("key.*", "value.*"))
    return _timed(kept, keys, values)


def corrected_windows(parts: DataFrame, keys: Sequence[str], values: Sequence[str], still_open: DataFrame | None = None) -> DataFrame:
    """Windows with their late parts added: counts, means, and ``origin``: written, corrected, or open."""
    rows = parts.withColumn("_origin", F.when(F.col("late") == 1, 1).otherwise(0)).drop("late")
    if still_open is not None:
        rows = rows.unionByName(still_open.withColumn("_origin", F.lit(2)))
    sums = [F.sum(f.name).alias(f.name) for f in _sums(values)]
    whole = rows.groupBy("window_start", "window_end", *keys).agg(*sums, F.max("_origin").alias("_origin"))
    origin = F.element_at(F.array(*map(F.lit, (WRITTEN, CORRECTED, OPEN))), F.col("_origin") + 1)
    means = [c for v in values for c in (F.col(f"{v}_cnt"), ratio(F.col(f"{v}_sum"), F.col(f"{v}_cnt")).alias(f"{v}_avr"))]
    return whole.select("window_start", "window_end", *keys, *means, origin.alias("origin"))

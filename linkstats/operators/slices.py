"""Ordered operators that never gather a whole key in one task.

A window over ``partitionBy(key)`` sorts all rows of a key in one task, which
fails when one key holds much of the data. Here time is cut into slices and the
big window runs over ``(key, slice)``. What crosses a slice border is one small
edge row per slice, computed by an aggregate that combines map-side. Edge rows
join the data by a union, so the big side is shuffled once, as with the plain
window.

The window over edges has at most (time span / slice width) rows per key, which
does not grow with the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstats.functions.times import MICROS, micros

SLICE_SECONDS = 60

_SLICE, _EDGE = "_slice", "_edge"


def slice_of(ts_micros: Column, seconds: int = SLICE_SECONDS) -> Column:
    """Begin of the time slice, in microseconds."""
    return ts_micros - F.pmod(ts_micros, F.lit(seconds * MICROS))


def _in_slice(keys: Sequence[str]) -> list[str]:
    return [*keys, _SLICE]


def with_neighbour(df: DataFrame, keys: Sequence[str], ts: str, values: dict[str, Column],
                   direction: str = "previous", tiebreak: Sequence[str] = (),
                   seconds: int = SLICE_SECONDS) -> DataFrame:
    """Add columns of the previous or next row of the same key in time order.

    ``values`` maps new column names to the expressions taken from that row;
    the first (or last) row of a key gets NULL. Time and ``tiebreak`` should be
    unique within a key (see ``operators.keys``): that bounds a slice by its width.
    """
    forward = direction == "next"
    order = [ts, *tiebreak]
    taken = F.struct(*[expr.alias(name) for name, expr in values.items()])
    rows = df.withColumns({_SLICE: slice_of(micros(ts), seconds), "_taken": taken})

    edge_row = F.struct(*order, "_taken")
    edges = (rows.groupBy(*_in_slice(keys))
             .agg((F.min if forward else F.max)(edge_row).alias(_EDGE)))
    by_key = Window.partitionBy(*keys).orderBy(_SLICE)
    beyond = F.lead(_EDGE).over(by_key) if forward else F.lag(_EDGE).over(by_key)
    edges = edges.withColumn(_EDGE, beyond).where(F.col(_EDGE).isNotNull())
    edges = edges.select(*_in_slice(keys), *[F.col(f"{_EDGE}.{c}").alias(c) for c in order],
                         F.col(f"{_EDGE}._taken").alias("_taken"), F.lit(True).alias("_is_edge"))

    both = rows.withColumn("_is_edge", F.lit(False)).unionByName(edges, allowMissingColumns=True)
    by_slice = Window.partitionBy(*_in_slice(keys)).orderBy(*order, "_taken")
    found = (F.lead if forward else F.lag)("_taken").over(by_slice)
    out = both.withColumn("_found", found).where(~F.col("_is_edge"))
    return out.select(*df.columns, *[F.col(f"_found.{name}").alias(name) for name in values])


def with_row_number(df: DataFrame, keys: Sequence[str], ts: str, name: str,
                    tiebreak: Sequence[str] = (), seconds: int = SLICE_SECONDS) -> DataFrame:
    """Number the rows of each key from 1 in time order."""
    rows = df.withColumn(_SLICE, slice_of(micros(ts), seconds))
    counts = rows.groupBy(*_in_slice(keys)).agg(F.count("*").alias("_n"))
    before = (Window.partitionBy(*keys).orderBy(_SLICE)
              .rowsBetween(Window.unboundedPreceding, -1))
    edges = counts.select(*_in_slice(keys), F.sum("_n").over(before).alias("_before"),
                          F.lit(0).alias("_is_row"))
    both = rows.withColumn("_is_row", F.lit(1)).unionByName(edges, allowMissingColumns=True)
    # The edge row sorts first in its slice and carries the rows counted before.
    by_slice = Window.partitionBy(*_in_slice(keys)).orderBy("_is_row", ts, *tiebreak)
    numbered = both.withColumns({
        "_position": F.row_number().over(by_slice),
        "_offset": F.coalesce(F.first("_before").over(by_slice), F.lit(0))})
    return (numbered.where(F.col("_is_row") == 1)
            .select(*df.columns, (F.col("_position") - 1 + F.col("_offset")).cast("int").alias(name)))


def probe_kind(number: str, mode: str = "echo") -> Column:
    """Kind of a run's n-th probe: the first connects; the others echo, or connect again in connect mode."""
    if mode == "connect":
        return F.when(F.col(number).isNotNull(), "CONN")
    if mode != "echo":
        raise ValueError(f"unknown probe mode: {mode}")
    return F.when(F.col(number) == 1, "CONN").when(F.col(number) > 1, "ECHO")


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def place_of(df: DataFrame, order: Sequence[str]) -> Column:
    """What rows of ``df`` are ordered by, as one value of a type that hash aggregates can hold where there is one.

    A single column stays plain. A time or whole number and a whole number to break ties become one decimal,
    exact for all times within 170,000 years. Other orders are structs.
    """
    if len(order) == 1:
        return F.col(order[0])
    kinds = [df.schema[c].dataType for c in order]
    if len(order) == 2 and isinstance(kinds[0], (*_WHOLE[:3], T.TimestampType)) and isinstance(kinds[1], _WHOLE):
        first = micros(order[0]) if isinstance(kinds[0], T.TimestampType) else F.col(order[0])
        return (first.cast("decimal(19,0)") * F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(38,0)") + F.col(
            order[1]).cast("decimal(20,0)")
    return F.struct(*order)


def trim_ends(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Drop the first and the last row of every recording.

    ``order`` must be unique within a recording. The two ends come from an aggregate, one row
    a recording, which meets the rows by key; adaptive execution splits a long recording there.
    """
    place = place_of(df, order)
    ends = df.groupBy(*keys).agg(F.min(place).alias("_first"), F.max(place).alias("_last"))
    at_end = (place == F.col("_first")) | (place == F.col("_last"))
    return df.join(ends, list(keys), "left").where(~F.coalesce(at_end, F.lit(False))).select(*df.columns)


def _clock(value: Column) -> Column:
    return F.floor(value / F.lit(MICROS))


def within_time_limit(df: DataFrame, keys: Sequence[str], ts: str, limit: int,
                      start: str | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Cut each run after its first row beyond the time limit (that row is kept).

    Elapsed time counts in whole clock seconds since ``start``, or since the first
    row of the run. A limit of 0 keeps everything. Rows are reduced to the first of
    each clock second before runs are looked at, so only the last join sees them
    all, and adaptive execution splits a hot run there.
    """
    if limit <= 0:
        return df
    place = place_of(df, [ts, *tiebreak])
    second = _clock(micros(ts)).alias("_second")
    begin = [] if start is None else [_clock(micros(start)).alias("_begin")]
    firsts = df.groupBy(*keys, second, *begin).agg(F.min(place).alias("_place"))
    if start is None:
        firsts = firsts.join(firsts.groupBy(*keys).agg(F.min("_second").alias("_begin")), list(keys))
    late = firsts.where(F.col("_second") - F.col("_begin") > limit)
    last = late.groupBy(*keys).agg(F.min("_place").alias("_last"))
    kept = df.join(last, list(keys), "left")
    return kept.where(F.col("_last").isNull() | (place <= F.col("_last"))).select(*df.columns)

"""Backward as-of join: the latest state at or before each probe's instant.

1. Probes are reduced to their distinct (key, instant) pairs, map-side first. All
   rows of a run share one instant, so this is far less than the facts. States are
   reduced to one per instant in the same way. A slice of w seconds then holds at
   most 2 w million rows of a key, whatever the size of the input.
2. Instants and states are cut into time slices. The state that holds when a
   slice begins is carried in as one extra row, so the window that fills the
   instants runs over (key, slice) and one hot key spreads over many tasks.
3. Facts get their state through an equi join on (key, instant). A hot pair is
   split by adaptive skew handling, which a window could not be.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linkstats.functions.times import micros
from linkstats.operators.slices import SLICE_SECONDS, slice_of


def resolve_instants(instants: DataFrame, states: DataFrame, keys: Sequence[str], ts: str,
                     state_ts: str, carry: dict[str, str], seconds: int = SLICE_SECONDS) -> DataFrame:
    """``instants`` (keys, ts; distinct, no NULL) that have a state, with its columns.

    ``carry`` maps output names to state columns; of two states at one instant the
    greater row wins, so the result does not depend on input order.
    """
    keys = list(keys)
    by_slice = [*keys, "_slice"]
    payload = F.struct(F.col(state_ts).alias("_at"),
                       *[F.col(column).alias(name) for name, column in carry.items()])
    points = instants.select(*keys, F.col(ts).alias("_ts"), slice_of(micros(ts), seconds).alias("_slice"))
    known = states.where(F.col(state_ts).isNotNull())
    for key in keys:
        known = known.where(F.col(key).isNotNull())
    # One state per instant, so copies of a state do not pile up in its slice.
    known = (known.groupBy(*keys, F.col(state_ts).alias("_ts")).agg(F.max(payload).alias("_state"))
             .withColumn("_slice", slice_of(micros("_ts"), seconds)))

    # Last state of each slice, and the slices that need one from before. Counting the
    # points keeps the plan on the instants already reduced, which both uses share.
    latest = known.groupBy(*by_slice).agg(F.max("_state").alias("_state"))
    asked = points.groupBy(*by_slice).agg(F.count("*").alias("_asked"))
    before = (Window.partitionBy(*keys).orderBy("_slice")
              .rangeBetween(Window.unboundedPreceding, -1))
    marks = (latest.withColumn("_asked", F.lit(0).cast("bigint"))
             .unionByName(asked, allowMissingColumns=True))
    carried = (marks.withColumn("_state", F.last("_state", ignorenulls=True).over(before))
               .where((F.col("_asked") > 0) & F.col("_state").isNotNull())
               .select(*by_slice, F.col("_state._at").alias("_ts"), "_state"))

    # Within a slice: a state comes before an instant of equal time, so equality matches.
    rows = (known.unionByName(carried).withColumn("_is_point", F.lit(False))
            .unionByName(points.withColumn("_is_point", F.lit(True)), allowMissingColumns=True))
    so_far = (Window.partitionBy(*by_slice).orderBy("_ts", "_is_point")
              .rowsBetween(Window.unboundedPreceding, 0))
    filled = (rows.withColumn("_held", F.last("_state", ignorenulls=True).over(so_far))
              .where(F.col("_is_point") & F.col("_held").isNotNull()))
    return filled.select(*keys, F.col("_ts").alias(ts),
                         *[F.col(f"_held.{name}").alias(name) for name in carry])


def asof_join(probes: DataFrame, states: DataFrame, on: dict[str, str], ts: str, state_ts: str,
              carry: dict[str, str], seconds: int = SLICE_SECONDS) -> DataFrame:
    """Left as-of join; probes without an earlier state get NULL in the carried columns.

    ``on`` maps probe key columns to state key columns, ``carry`` maps new column
    names to state columns.
    """
    keys = list(on)
    sided = states.select(*[F.col(state_key).alias(key) for key, state_key in on.items()],
                          F.col(state_ts).alias("_state_ts"),
                          *[F.col(column).alias(f"_carry_{name}") for name, column in carry.items()])
    instants = probes.select(*keys, ts).dropna().distinct()
    resolved = resolve_instants(instants, sided, keys, ts, "_state_ts",
                                {name: f"_carry_{name}" for name in carry}, seconds)
    return probes.join(resolved, [*keys, ts], "left").select(*probes.columns, *carry)

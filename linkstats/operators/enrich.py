"""Attach lookups and states to probes; derive the views the reports read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkstats.functions.measures import SignalThresholds, device_mode, signal_quality
from linkstats.functions.times import MICROS, micros
from linkstats.operators.asof import asof_join
from linkstats.operators.slices import SLICE_SECONDS, with_neighbour

STATE_COLUMNS = ("dev_mode", "rssi", "lte_rsrq", "lte_rsrp")


def with_interface(probes: DataFrame, addresses: DataFrame, operators: DataFrame) -> DataFrame:
    """Look up interface by address and operator by interface; a miss is NULL.

    ``addresses`` is (sched_id, local_ip, if_name), ``operators`` is (sched_id,
    if_name, oper). Neither is hinted: Spark broadcasts them only below its size limit.
    """
    return (probes.join(addresses, ["sched_id", "local_ip"], "left")
            .join(operators, ["sched_id", "if_name"], "left"))


def with_state(probes: DataFrame, states: DataFrame, ts: str = "run_dtm",
               seconds: int = SLICE_SECONDS) -> DataFrame:
    """Attach ``m_ts`` and the state columns that held at ``ts``.

    ``ts='run_dtm'`` gives all rows of a run the state at its start; pass the row's
    own time for a state per row.
    """
    carry = {"m_ts": "ts"} | {name: name for name in STATE_COLUMNS}
    return asof_join(probes, states, {"sched_id": "sched_id", "if_name": "iif_name"}, ts, "ts",
                     carry, seconds)


def join_state(probes: DataFrame, states: DataFrame) -> DataFrame:
    """Attach state columns to probes that already store ``m_ts``."""
    side = states.select("sched_id", F.col("ts").alias("m_ts"), *STATE_COLUMNS)
    return probes.join(side, ["sched_id", "m_ts"], "left").select(*probes.columns, *STATE_COLUMNS)


def classified(df: DataFrame, limits: SignalThresholds = SignalThresholds()) -> DataFrame:
    """Add ``device_mode`` and ``signal_quality`` (the three views share this)."""
    return df.withColumns({"device_mode": device_mode("dev_mode"),
                           "signal_quality": signal_quality(limits=limits)})


def with_span(states: DataFrame, keys: tuple[str, ...] = ("sched_id", "iif_name"), ts: str = "ts",
              tiebreak: tuple[str, ...] = ("seq_no",), seconds: int = SLICE_SECONDS) -> DataFrame:
    """Seconds until the next state of the same interface; the last one gets 0."""
    rows = with_neighbour(states, keys, ts, {"_next": micros(ts)}, "next", tiebreak, seconds)
    span = (F.col("_next") - micros(ts)) / F.lit(float(MICROS))
    return rows.withColumn("span", F.coalesce(span, F.lit(0.0))).drop("_next")

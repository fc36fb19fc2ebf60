"""Timestamps: from file names, from epochs, and differences in seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkstats.functions.measures import ColumnOrName, _col

MICROS = 1_000_000


def name_timestamp(day: ColumnOrName, clock: ColumnOrName) -> Column:
    """Timestamp (session zone UTC) from ``yyyyMMdd`` and ``HHmmss`` digit runs.

    Digits beyond these lengths are ignored; too few give NULL.
    """
    text = F.concat(F.substring(_col(day), 1, 8), F.substring(_col(clock), 1, 6))
    return F.try_to_timestamp(text, F.lit("yyyyMMddHHmmss"))


def name_epoch(day: ColumnOrName, clock: ColumnOrName) -> Column:
    return F.unix_timestamp(name_timestamp(day, clock))


def epoch_timestamp(seconds: ColumnOrName) -> Column:
    """Timestamp from float epoch seconds, to the nearest microsecond."""
    return F.timestamp_micros(F.round(_col(seconds) * float(MICROS)).cast("bigint"))


def micros(ts: ColumnOrName) -> Column:
    return F.unix_micros(_col(ts).cast("timestamp"))


def elapsed_seconds(begin: ColumnOrName, end: ColumnOrName) -> Column:
    return (micros(end) - micros(begin)) / F.lit(float(MICROS))

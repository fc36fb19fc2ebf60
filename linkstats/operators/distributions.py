"""Shares of time, shares of counts, ratio histograms and breakdowns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkstats.functions.measures import exact_mean, ratio, round_to, to_mib, to_ms, to_percent

# Inclusive buckets of a share, by column name.
SHARE_BUCKETS = {
    "no_diff_pct": (0.0, 0.0001),
    "to_20_pct": (0.0001, 0.2),
    "to_40_pct": (0.2001, 0.4),
    "to_60_pct": (0.4001, 0.6),
    "to_80_pct": (0.6001, 0.8),
    "above_80_pct": (0.8001, 1.0),
}


def span_parts(column: str, categories: dict[str, str], span: str = "span") -> dict[str, Column]:
    """Additive parts of a time share: time in each category and time in all."""
    parts = {f"span_{name}": F.sum(F.when(F.col(column) == value, F.col(span)).otherwise(F.lit(0.0)))
             for name, value in categories.items()}
    return parts | {"span_all": F.sum(span)}


def share_columns(names: Sequence[str], prefix: str, whole: str, suffix: str = "",
                  digits: int | None = 2) -> list[Column]:
    """``<name>_pct`` columns: 100 * part / whole."""
    out = []
    for name in names:
        share = ratio(F.col(f"{prefix}{name}{suffix}") * F.lit(100.0), whole)
        out.append((share if digits is None else round_to(share, digits)).alias(f"{name}_pct{suffix}"))
    return out


def span_distribution(states: DataFrame, keys: Sequence[str], column: str,
                      categories: dict[str, str]) -> DataFrame:
    """Percent of observed time per category, by key."""
    parts = states.groupBy(*keys).agg(
        *[c.alias(n) for n, c in span_parts(column, categories).items()])
    return parts.select(*keys, *share_columns(list(categories), "span_", "span_all"))


def bucket_parts(share: Column, ratio_scale: int | None = 4,
                 buckets: dict[str, tuple[float, float]] | None = None) -> dict[str, Column]:
    """Additive parts of the histogram: rows per bucket.

    The edges leave gaps below 0.0001 between buckets; ``ratio_scale=4`` rounds
    the share to their four decimals first, ``None`` compares it as it is.
    """
    if ratio_scale is not None:
        share = round_to(share, ratio_scale)
    return {name: F.sum(F.when(share.between(low, high), 1).otherwise(0))
            for name, (low, high) in (buckets or SHARE_BUCKETS).items()}


def share_histogram(df: DataFrame, keys: Sequence[str], share: Column,
                    ratio_scale: int | None = 4) -> DataFrame:
    """Percent of rows per bucket, by key."""
    parts = bucket_parts(share, ratio_scale)
    counted = df.groupBy(*keys).agg(F.count("*").alias("cnt"),
                                    *[c.alias(n) for n, c in parts.items()])
    return counted.select(*keys, "cnt", *[
        round_to(to_percent(ratio(name, "cnt")), 2).alias(name) for name in parts])


def rtt_breakdown(pings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of pings and mean round trip by one or more categories."""
    return pings.groupBy(*keys).agg(F.count("*").alias("cnt"),
                                    round_to(to_ms(exact_mean("rtt")), 1).alias("rtt_ms"))


def speed_breakdown(downloads: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Number of downloads and their throughput by one or more categories."""
    speed = ratio(F.sum("dwnl_size"), F.sum(F.col("total_time") - F.col("init_time")))
    return downloads.groupBy(*keys).agg(F.count("*").alias("cnt"),
                                        round_to(to_mib(speed), 2).alias("speed_mbs"))


def weighted_mean(weight: str, value: str) -> tuple[Column, Column]:
    """Numerator and denominator of a count-weighted mean.

    A NULL value drops out of the numerator but its weight stays below.
    """
    return F.sum(F.col(weight) * F.col(value)), F.sum(weight)

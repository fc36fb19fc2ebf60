"""Key checks: uniqueness of primary keys and of lookup mappings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class DuplicateKeyError(ValueError):
    """A table breaks its primary key."""


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("cnt")).where(F.col("cnt") > 1)


def require_unique(df: DataFrame, keys: Sequence[str], table: str = "table") -> DataFrame:
    """``df`` itself; raises when a key occurs twice. Runs a job."""
    if not duplicate_keys(df, keys).isEmpty():
        raise DuplicateKeyError(f"{table} repeats a key of ({', '.join(keys)})")
    return df


def _bounds(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    known = df.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))


def unique_mapping(df: DataFrame, keys: Sequence[str], value: str, strict: bool = True) -> DataFrame:
    """One value per key. Where a key maps to several values, a strict mapping
    raises when it is evaluated, and a lenient one leaves the key out."""
    bounds = _bounds(df, keys, value)
    clear = F.col("_low") == F.col("_high")
    if not strict:
        return bounds.where(clear).select(*keys, F.col("_low").alias(value))
    return bounds.select(*keys, _checked(clear, keys, value, df).alias(value))


def _checked(clear: Column, keys: Sequence[str], value: str, df: DataFrame) -> Column:
    names = F.concat_ws(", ", *[F.col(key).cast("string") for key in keys])
    problem = F.concat(F.lit(f"{value} changed for "), names)
    return F.when(clear, F.col("_low")).otherwise(
        F.raise_error(problem).cast(df.schema[value].dataType))


def mapping_conflicts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys that map to more than one value, with the two extremes."""
    return (_bounds(df, keys, value).where(F.col("_low") != F.col("_high"))
            .withColumnsRenamed({"_low": f"{value}_min", "_high": f"{value}_max"}))

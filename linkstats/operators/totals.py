"""Groups and a TOTAL row from one pass over the data.

Facts are aggregated once, by group, into additive parts. The TOTAL row adds up
those parts (one row per group), so the data is neither read nor expanded twice.
A TOTAL row is given for empty input as well.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOTAL = "TOTAL"


def additive_parts(facts: DataFrame, keys: Sequence[str], parts: dict[str, Column]) -> DataFrame:
    """Aggregate into parts that may be summed again (sums and counts)."""
    return facts.groupBy(*keys).agg(*[column.alias(name) for name, column in parts.items()])


def with_total(parts: DataFrame, keys: Sequence[str], label: Column, names: Sequence[str],
               label_name: str, counts: Sequence[str] = ()) -> DataFrame:
    """Parts under a group label, and their sum labelled TOTAL.

    Every group row also counts towards the total, and a seed row without values
    makes the total appear when there is no group. Names in ``counts`` are row
    counts, whose total over nothing is 0.
    """
    kinds = dict(parts.dtypes)
    no_keys = [F.lit(None).cast(kinds[key]).alias(key) for key in keys]
    as_group = F.struct(*keys, label.alias(label_name), F.lit(False).alias("is_total"))
    as_total = F.struct(*no_keys, F.lit(TOTAL).alias(label_name), F.lit(True).alias("is_total"))
    seed = parts.sparkSession.range(1).select(
        as_total.alias("_group"),
        *[F.lit(0 if name in counts else None).cast(kinds[name]).alias(name) for name in names])
    rows = parts.select(F.explode(F.array(as_group, as_total)).alias("_group"), *names).unionByName(seed)
    summed = rows.groupBy("_group").agg(*[F.sum(name).alias(name) for name in names])
    return summed.select(F.col(f"_group.{label_name}").alias(label_name), *names)

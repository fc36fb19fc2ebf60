"""Running products over ordered rows of keys, however many rows one key has.

Rows are dealt by ranges of (key, order) and sorted in their partition, so the rows of a key lie in one run, or
in runs at the borders of neighbouring partitions. A task combines the values of a run one after the other; a
run that continues one of an earlier partition is then combined with what came before. Only the totals at the
ends of partitions, one row for each, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstats.llm.common import stage

Value = tuple[int, ...]
LONGS = pa.int64()


def running(df: DataFrame, key: str, order: list[Column], values: list[str], combine: Callable[[Value, Value], Value],
            label: str) -> DataFrame:
    """``df`` with ``values`` (longs, as is ``key``; no nulls) replaced by their product from the first row of the
    key on. ``combine`` is associative."""
    names = df.columns
    columns = [names.index(v) for v in values]
    at_key = names.index(key)
    schema = T.StructType([*df.schema.fields, *(T.StructField(n, T.LongType()) for n in ("run_part", "run_row", "run_end"))])

    def swapped(batch: pa.RecordBatch, products: list[Value], *more: list[int]) -> pa.RecordBatch:
        held = list(batch.columns)
        for c, column in zip(columns, zip(*products)):
            held[c] = pa.array(column, LONGS)
        return pa.RecordBatch.from_arrays([*held, *(pa.array(v, LONGS) for v in more)], names=schema.names)

    def rows(batches: Iterator) -> Iterator:
        part, row, last, product, held = TaskContext.get().partitionId(), 0, None, None, None
        for batch in batches:
            n = batch.num_rows
            if n:
                if held:
                    yield swapped(*held, [0] * held[0].num_rows)
                products = []
                for k, value in zip(batch.column(at_key).to_pylist(), zip(*(batch.column(c).to_pylist() for c in columns))):
                    product = value if k != last else combine(product, value)
                    last = k
                    products.append(product)
                held = batch, products, [part] * n, list(range(row, row + n))
                row += n
        if held:
            yield swapped(*held, [0] * (held[0].num_rows - 1) + [1])

    ordered = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    found = stage(ordered.mapInArrow(rows, schema), label)
    borders = found.filter((F.col("run_row") == 0) | (F.col("run_end") == 1)).select(
        "run_part", "run_end", key, *values).orderBy("run_part", "run_row").collect()
    before: dict[int, tuple[int, Value]] = {}
    last = total = first = None
    for part, end, k, *own in borders:  # the first row of a partition, if it is not the last as well, then the last
        if part not in before and first != part and k == last:
            before[part] = last, total
        first = part
        if end:
            carried_on = part in before and k == before[part][0]
            last, total = k, combine(before[part][1], tuple(own)) if carried_on else tuple(own)
    if not before:
        return found.select(*names)

    def carried(batches: Iterator) -> Iterator:
        for batch in batches:
            if batch.num_rows:
                products = [
                    combine(before[p][1], value) if before[p][0] == k else value
                    for p, k, value in zip(batch.column("run_part").to_pylist(), batch.column(at_key).to_pylist(),
                                           zip(*(batch.column(c).to_pylist() for c in columns)))]
                yield swapped(batch, products)

    inside = F.col("run_part").isin(*before)
    return found.filter(~inside).union(found.filter(inside).mapInArrow(carried, schema)).select(*names)

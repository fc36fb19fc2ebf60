"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkstats.session import scratch_dir

#: The ASCII white space that the contracts name, [\x20\x09-\x0D].
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stage(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write a frame to the shared scratch folder and read it back.

    This cuts the lineage: whatever is lost later is read again, not computed again.
    """
    path = scratch_dir(df.sparkSession, label)
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only. Pure ASCII takes the fast path, with the same result."""
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER))


def held_out(doc_id: Column) -> Column:
    """Every fifth document by checksum of its id. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but for ``names``, compared without case as Spark does."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def arrow_batches(schema: T.StructType, rows: Iterable[tuple], size: int = 4096,
                  most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded count and size (texts and binaries are counted)."""
    kinds = pa.schema([(f.name, _arrow_type(f.dataType)) for f in schema])
    held: list[tuple] = []
    weight = 0
    for row in rows:
        held.append(row)
        weight += sum(len(v) for v in row if isinstance(v, (bytes, str)))
        if len(held) >= size or weight >= most_bytes:
            yield _batch(kinds, held)
            held, weight = [], 0
    if held:
        yield _batch(kinds, held)


def _batch(kinds: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kinds)],
                                      schema=kinds)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    simple = {T.LongType(): pa.int64(), T.IntegerType(): pa.int32(), T.DoubleType(): pa.float64(),
              T.FloatType(): pa.float32(), T.StringType(): pa.string(), T.BinaryType(): pa.binary(),
              T.BooleanType(): pa.bool_(), T.ByteType(): pa.int8(), T.ShortType(): pa.int16()}
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return simple[kind]


def schema_of(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)

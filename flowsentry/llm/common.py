"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowsentry.session import configure

#: Arrow batches between the JVM and Python stay below this size, however long the texts are.
BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> SparkSession:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str | Column, modulus: int) -> Column:
    """crc32 of the key's text, modulo ``modulus``; a null key counts as the empty text."""
    column = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(column.cast("string"), F.lit(""))) % modulus


def arrow_schema(schema: T.StructType) -> pa.Schema:
    kinds = {
        T.LongType: pa.int64(),
        T.IntegerType: pa.int32(),
        T.DoubleType: pa.float64(),
        T.StringType: pa.string(),
        T.BinaryType: pa.binary(),
        T.BooleanType: pa.bool_(),
    }

    def kind(t):
        return pa.list_(kind(t.elementType)) if isinstance(t, T.ArrayType) else kinds[type(t)]

    return pa.schema([pa.field(f.name, kind(f.dataType)) for f in schema])


def map_rows(df: DataFrame, rows, schema: str) -> DataFrame:
    """``rows(batches)`` turns the record batches of a partition into tuples in the order of ``schema``."""
    out = T.StructType.fromDDL(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(rows(batches), out)

    return df.mapInArrow(run, out)


def batched(tuples: Iterable[tuple], schema: T.StructType, most_rows: int = 4096, most_bytes: int = BATCH_BYTES):
    """Record batches of bounded size."""
    target = arrow_schema(schema)
    held, size = [], 0

    def flush():
        columns = [list(c) for c in zip(*held)]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, target)], schema=target)

    for row in tuples:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, (str, bytes)))
        if len(held) >= most_rows or size >= most_bytes:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()

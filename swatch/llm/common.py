"""Helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_HELD: dict = {}


def held(key, build: Callable):
    """What a task's process remembers under ``key`` from one task to the next.  A process serves one operator after the other and
    holds the memory of one at a time: whatever another one left is dropped."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = build()
    return _HELD[key]


def drop_held() -> None:
    """For operators that remember nothing beyond a task: what others left is dropped."""
    _HELD.clear()


DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


_ARROW = {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.ShortType: pa.int16(), T.ByteType: pa.int8(), T.DoubleType: pa.float64(),
          T.FloatType: pa.float32(), T.BooleanType: pa.bool_(), T.StringType: pa.string(), T.BinaryType: pa.binary(),
          T.DateType: pa.date32(), T.TimestampNTZType: pa.timestamp("us"), T.TimestampType: pa.timestamp("us", "UTC")}


def arrow_type(kind: T.DataType) -> pa.DataType:
    """The Arrow type in which Spark takes a column of this type."""
    if isinstance(kind, T.ArrayType):
        return pa.list_(pa.field("element", arrow_type(kind.elementType), kind.containsNull))
    if isinstance(kind, T.StructType):
        return pa.struct(list(arrow_schema(kind)))
    if isinstance(kind, T.DecimalType):
        return pa.decimal128(kind.precision, kind.scale)
    return _ARROW[type(kind)]


def arrow_schema(schema: T.StructType) -> pa.Schema:
    return pa.schema([pa.field(f.name, arrow_type(f.dataType), f.nullable) for f in schema.fields])


def map_rows(df: DataFrame, fn: Callable, schema: T.StructType, rows_per_step: int = 512) -> DataFrame:
    """Apply ``fn(list per input column) -> list of arrays or lists per output column`` batch-wise.

    Arrow batches are cut into steps of ``rows_per_step`` rows, so a task holds the Python values of
    one step at a time whatever the partition's size.
    """
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows_per_step):
                part = batch.slice(at, rows_per_step)
                out = fn(*[c.to_pylist() for c in part.columns])
                arrays = [a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(out, arrow)]
                yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def list_array(values, lengths, kind) -> pa.ListArray:
    """Arrow list column from concatenated numpy ``values`` and the length of each row."""
    import numpy as np

    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))

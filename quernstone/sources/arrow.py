"""Sources that are in memory: Arrow streams and batches, empty tables; columns made by
Python code from Arrow batches."""

from __future__ import annotations

import ctypes
import io

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import ResourceExhausted, Validation


def decode_stream(spark: SparkSession, body: bytes) -> DataFrame:
    """The rows of an Arrow IPC stream."""
    try:
        with pa.ipc.open_stream(io.BytesIO(body)) as reader:
            return spark.createDataFrame(reader.read_all())
    except (pa.ArrowInvalid, OSError) as e:
        raise Validation(f"no Arrow stream: {e}") from None


STREAM_MAX = 1_000_000  # rows of a stream that is made in the driver


def encode_stream(df: DataFrame, most: int = STREAM_MAX) -> bytes:
    """A result of at most so many rows as an Arrow IPC stream; an error beyond."""
    table, sink = df.limit(most + 1).toArrow(), io.BytesIO()
    if table.num_rows > most:
        raise ResourceExhausted(f"more than {most} rows")
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue()


def batches(spark: SparkSession, name: str, parts: list[pa.RecordBatch], schema: T.StructType | None = None) -> DataFrame:
    """Collected batches under a name; none gives an empty table of the schema."""
    if not parts and schema is None:
        raise Validation(f"{name} has neither batches nor a schema")
    df = spark.createDataFrame(pa.Table.from_batches(parts)) if parts else empty(spark, schema)
    df.createOrReplaceTempView(name)
    return df


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


BATCH_BYTES = 8 << 20  # of an Arrow batch that Python code works on at once, or one row of more


def release() -> None:
    """Gives memory back that this worker process doesn't need: it stays alive
    between tasks and shares its executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def arrow_map(df: DataFrame, function, schema) -> DataFrame:
    """df.mapInArrow with batches of about BATCH_BYTES, tidied up after each task."""

    def small(batches):
        for b in batches:
            step = max(1, b.num_rows * BATCH_BYTES // max(b.nbytes, 1))
            for lo in range(0, b.num_rows, step):
                yield b.slice(lo, step)

    def run(batches):
        try:
            yield from function(small(batches))
        finally:
            release()

    return df.mapInArrow(run, schema)

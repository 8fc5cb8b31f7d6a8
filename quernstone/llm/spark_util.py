"""Session helpers: table reading, bounded samples, columns made from Arrow arrays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.arrow import BATCH_BYTES, arrow_map, release  # noqa: F401  for the operators
from ..sources.scratch import cut, discard, settled, shared_dir  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


def fresh(df: DataFrame, name: str) -> str:
    """name, with as many underscores before it as make it no column of df."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def blocks(batches, place: int, limit: int):
    """(block number, rows) of the task's input in turn: as many rows as hold at
    most limit bytes in the string column at place, or one row of more.  It
    depends on the rows alone, not on how they are dealt to batches."""
    import numpy as np
    import pyarrow as pa
    from pyspark import TaskContext

    from .textnum import utf8

    number, rows, size = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        off = utf8(batch.column(place))[1]
        lo, n = 0, batch.num_rows
        while lo < n:
            hi = min(int(np.searchsorted(off, off[lo] + limit - size, "right")) - 1, n)
            hi = max(hi, lo if rows else lo + 1)
            if hi > lo:
                rows.append(batch.slice(lo, hi - lo))
                size += int(off[hi] - off[lo])
            if hi < n:
                yield number, pa.concat_batches(rows)
                number, rows, size = number + 1, [], 0
            lo = hi
    if rows:
        yield number, pa.concat_batches(rows)


def extend(df: DataFrame, column: str, function, fields: str) -> DataFrame:
    """df with further columns (fields, as DDL) that function makes from the
    Arrow array of one column, batch by batch; columns of those names go first."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    more = StructType.fromDDL(fields)
    df = df.select([c for c in df.columns if c == column or c not in more.names])
    place = df.columns.index(column)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *function(batch.column(place))], [*batch.schema.names, *more.names])

    return arrow_map(df, run, StructType([*df.schema.fields, *more.fields]))


HOT_KEYS = 10_000  # keys that hold more than one in so many of all rows; there can't be more than so many of them


def skew_join(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """rows joined (inner or left) with facts, which has one row for each key and,
    in column n (dropped), how many of the total rows have it.  Hot keys' facts are
    broadcast (HOT_KEYS rows at most), so their rows stay where they are; no other
    key has more than total / HOT_KEYS rows in a task."""
    from pyspark.sql import functions as F

    least = total / HOT_KEYS
    hot = F.broadcast(facts.where(F.col(n) > least).drop(n))
    cold = facts.where(F.col(n) <= least).drop(n)
    rest = rows.join(F.broadcast(facts.where(F.col(n) > least).select(*keys)), keys, "left_anti")
    return rows.join(hot, keys).unionByName(rest.join(cold, keys, how), allowMissingColumns=True)


def bounded_sample(df: DataFrame, key: str, limit: int) -> DataFrame:
    """About limit rows: those of the least hashes of key (rows of one key go together)."""
    from pyspark.sql import functions as F

    h = F.xxhash64(F.col(key).cast("string"))
    last = df.select(h.alias("h")).orderBy("h").limit(limit).agg(F.max("h")).first()[0]
    return df.where(h <= F.lit(last)) if last is not None else df.limit(0)


def sample_rows(df: DataFrame, key: str, text: str, max_bytes: int) -> list:
    """The rows of df (a bounded sample), in the order of their key's hashes, as
    long as their texts hold max_bytes together."""
    from pyspark.sql import functions as F

    some = cut(df.withColumn("__h", F.xxhash64(F.col(key).cast("string"))))
    total, last = 0, None
    for h, n in sorted((r[0], r[1]) for r in some.select("__h", F.octet_length(text)).collect()):
        total += n
        if total > max_bytes:
            break
        last = h
    return some.where(F.col("__h") <= F.lit(last)).drop("__h").collect() if last is not None else []


def held_out(key: str = "doc_id"):
    """Rows that no model learns from: crc32 of the id's text modulo 3 is 1."""
    from pyspark.sql import functions as F

    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))

"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """A new path under spark.checkpoint.dir.  A temporary folder stands in only
    where the setting is absent and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(spark, "_quern_shared", None) or tempfile.mkdtemp(prefix="quern-shared-")
        spark._quern_shared = root
    return f"{root.rstrip('/')}/quern-{uuid.uuid4().hex}"


_local = threading.local()  # a thread deletes only what it has cut itself


def _scopes() -> list[list[str]]:
    return _local.__dict__.setdefault("scopes", [])


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: cuts its lineage, and
    what follows survives lost executors without computing it anew."""
    path = shared_dir(df.sparkSession)
    if _scopes():
        _scopes()[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def settled(spark: SparkSession, make) -> DataFrame:
    """cut(make()); what make() has cut on its way is deleted after that."""
    _scopes().append([])
    try:
        made = make()
    finally:
        inner = _scopes().pop()
    out = cut(made)
    discard(spark, inner)
    return out


def discard(spark: SparkSession, what: list[str] | DataFrame) -> None:
    """Deletes folders made by cut(), or the one that a DataFrame of cut() reads."""
    for path in [what._quern_path] if isinstance(what, DataFrame) else what:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)

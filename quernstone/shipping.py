"""Sends this package to the executors, so their Python workers can import it."""

from __future__ import annotations

import shutil
import tempfile
from functools import wraps
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application: the package as a zip file on all workers' path."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    root = Path(__file__).resolve().parent
    with tempfile.TemporaryDirectory() as folder:
        copy = Path(folder, "package")
        shutil.copytree(root, copy / root.name, ignore=shutil.ignore_patterns("__pycache__"))
        kept = Path(tempfile.mkdtemp(prefix="quern-code-"), "quern_code")
        sc.addPyFile(shutil.make_archive(str(kept), "zip", copy))
    _sent.add(sc.applicationId)


def shipped(function):
    """function(spark, ...) after ship(spark)."""

    @wraps(function)
    def run(spark, *args, **options):
        ship(spark)
        return function(spark, *args, **options)

    return run

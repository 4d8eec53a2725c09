"""Shared scratch tables for iterative operators.

An iteration writes its state as Parquet below ``spark.checkpoint.dir`` and reads it
back.  That cuts the lineage, lets the optimizer see real sizes, and survives lost
executors, as every executor reads the same folder.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset (tests on one machine), a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="plexigraph-scratch-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = f"file://{path}"
    return _OWN[app]


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the session was started."""
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[1])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


class Scratch:
    """The folder of one run of an operator: tables by name, dropped one by one or all at once."""

    def __init__(self, spark: SparkSession, what: str):
        self.spark, self.path = spark, f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns it as read back."""
        at = f"{self.path}/{name}"
        df.write.option("compression", "zstd").parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)

    def drop(self, name: str) -> None:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)

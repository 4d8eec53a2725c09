"""Table access, shared scratch tables and byte-level text helpers.

Scratch tables take the place of lineage: they are Parquet, written by
Spark's own writer under the folder that ``spark.checkpoint.dir`` names, so
that every executor sees them and a lost executor costs one task, not a chain
of stages.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the session was started.

    On a cluster the package must be installed there or sent by --py-files.
    """
    env, here = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named driver table as a DataFrame."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for scratch tables.

    The session's ``spark.checkpoint.dir`` if set.  Where it is unset (tests on
    one machine) a temporary folder is made, and removed at exit.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="plexigraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = f"file://{path}"
    return _OWN[app]


#: Spark's setting that a query's shuffle files go when it ends, not when the driver next collects garbage.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stash:
    """A DataFrame written to, and read back from, the shared folder.

    The plan runs once, so its shuffle files are deleted with it.
    """

    def __init__(self, df: DataFrame, tag: str):
        spark = df.sparkSession
        self.path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
        before = spark.conf.get(FREED, "false")
        spark.conf.set(FREED, "true")
        try:
            df.write.option("compression", "zstd").parquet(self.path)
        finally:
            spark.conf.set(FREED, before)
        self.df = spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Deletes the files; what still reads ``df`` must have run."""
        remove(self.df.sparkSession, self.path)


def stash(df: DataFrame, tag: str) -> DataFrame:
    """:class:`Stash` for tables that the returned result goes on to read."""
    return Stash(df, tag).df


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in whatever file system it names."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


# -- bytes of Arrow strings ------------------------------------------------


def column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def raw_texts(col: pa.Array):
    """Yields each value's UTF-8 bytes as a uint8 view; None for null.

    The views share Arrow's buffer: no text is decoded or copied.
    """
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(col)
    valid = col.is_valid().to_numpy(zero_copy_only=False)
    _, offsets, data = col.buffers()
    if offsets is None:
        yield from (None if not ok else np.zeros(0, np.uint8) for ok in valid)
        return
    at = np.frombuffer(offsets, kind, n + 1, col.offset * np.dtype(kind).itemsize)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    for i in range(n):
        yield whole[at[i] : at[i + 1]] if valid[i] else None


#: The separators of contract words: space, and the controls 9 to 13.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse, modulo 2**64."""
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    up[0] = down[0] = 1
    up[1:] = _ODD
    down[1:] = np.uint64(_inverse(int(_ODD)))
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down)


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end byte of every word (a run without separators)."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~SPACE[raw]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word, in whole-array steps.

    A polynomial hash by prefix sums: hash(start, end) is the difference of two
    prefix sums, moved back by an inverse power of the base, then mixed with
    the length.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = 1 << max(12, int(len(raw)).bit_length())
    up, down = _powers(size)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        part = (sums[ends] - sums[starts]) * down[starts]
        return mix64(part + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

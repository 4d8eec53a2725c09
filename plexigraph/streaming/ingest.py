"""Continuous graph ingest and per-vertex state on Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..scratch import importable
from ..store import Store


def ingest(ops: DataFrame, store: Store, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Commits each micro-batch of operations to the store; transactions that break a rule are left out.

    A batch that Spark repeats after a failure finds the number of its commit in the
    store's batch log and is skipped, so each takes effect once.
    """

    def commit(batch: DataFrame, number: int) -> None:
        done = f"{store.path}/batches/{number}"
        fs = store.spark.sparkContext._jvm.org.apache.hadoop.fs
        if store._files.exists(fs.Path(done)):
            return
        store.commit(batch.select("tx_id", "seq", "op", "handle", "handle1", "handle2", "alias1", "alias2", "key", "value"), atomic=False)
        store._files.create(fs.Path(done), True).close()

    return ops.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def deduplicated(ops: DataFrame, time_col: str, delay: str = "10 minutes") -> DataFrame:
    """Operations once each, by (tx_id, seq), within the watermark; later ones are dropped."""
    return ops.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["tx_id", "seq"])


def windowed_writes(ops: DataFrame, time_col: str, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, op, n): operations by event-time window, complete once the watermark has passed."""
    return ops.withWatermark(time_col, delay).groupBy(F.window(time_col, window).alias("w"), "op").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "op", "n")


def degrees(edges: DataFrame) -> DataFrame:
    """(src, degree): a running out-degree for each vertex of a stream of edges, kept as state per vertex."""
    importable(edges.sparkSession)

    def update(key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = (state.get[0] if state.exists else 0) + sum(len(r) for r in rows)
        state.update((n,))
        yield pd.DataFrame({"src": [key[0]], "degree": [n]})

    kind = edges.schema["src"].dataType.simpleString()
    return edges.groupBy("src").applyInPandasWithState(update, f"src {kind}, degree long", "n long", "update", GroupStateTimeout.NoTimeout)

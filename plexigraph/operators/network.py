"""Feed-forward inference on a network stored as a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..errors import NotFoundError, UnfinishedError
from ..functions.scalars import activation
from ..model import Snapshot
from ..scratch import Scratch


def _links(snap: Snapshot, direction: str) -> DataFrame:
    out = snap.edges.having({"dir": direction}).select("handle", "src", "dst")
    for key in ("weight", "order") if direction == "f" else ():
        out = out.join(snap.edges.value(key).withColumnRenamed("value", key), "handle")
    return out


def infer(snap: Snapshot, start: str, end: str, values: list[float], function: str = "sigmoid", max_layers: int = 100_000) -> list[float]:
    """The output vector at ``end`` for the input vector ``values`` at ``start``.

    Forward edges (dir = f) carry a weight and an order; a node waits for as many messages
    as it has backward edges (dir = b), sums them and applies the activation.  The last
    node puts each message at its edge's order, without activation.  An edge without a numeric
    weight or order is not used.  All nodes of a layer are computed in one job.
    """
    scratch = Scratch(snap.spark, "network")
    links = _links(snap, "f").select("src", "dst", F.col("weight").try_cast("double").alias("weight"), F.col("order").try_cast("int").alias("order"))
    links = scratch.save(links.filter("weight is not null and order is not null"), "links")
    waits = scratch.save(_links(snap, "b").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("waits")), "waits")
    given = F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("order") + 1)
    sent = links.filter(F.col("src") == start).filter(f"order >= 0 and order < {len(values)}").select("dst", "order", (F.col("weight") * given).alias("m"))
    pending = snap.spark.createDataFrame([], "node string, total double, n long")
    last = snap.spark.createDataFrame([], "order int, m double")
    for layer in range(max_layers + 1):
        sent = scratch.save(sent, f"sent{layer}")
        if sent.isEmpty():
            break
        if layer == max_layers:
            raise UnfinishedError(f"signals are left after {max_layers} layers; the network has a cycle, or more of them")
        last = scratch.save(last.unionByName(sent.filter(F.col("dst") == end).select("order", "m")), f"last{layer}")
        arrived = sent.filter(F.col("dst") != end).select(F.col("dst").alias("node"), F.col("m").alias("total"), F.lit(1).cast("bigint").alias("n"))
        pending = pending.unionByName(arrived).groupBy("node").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
        pending = scratch.save(pending.join(waits, "node", "left").withColumn("ready", F.coalesce(F.col("n") >= F.col("waits"), F.lit(False))), f"pending{layer}")
        ready = pending.filter("ready").select(F.col("node").alias("src"), activation(F.col("total"), function).alias("x"))
        pending = pending.filter("not ready").select("node", "total", "n")
        sent = links.join(ready, "src").select("dst", "order", (F.col("weight") * F.col("x")).alias("m"))
    rows = {r["order"]: r["m"] for r in last.groupBy("order").agg(F.last("m").alias("m")).collect()}  # as wide as the output layer
    if not rows:
        raise NotFoundError(f"no signal reaches {end}")
    return [rows.get(i, 0.0) for i in range(max(rows) + 1)]


def dense_layer(weights: DataFrame, inputs: DataFrame, function: str = "sigmoid", decimals: int | None = None) -> DataFrame:
    """(dst, y): one layer for all neurons: ``weights`` (src, dst, w), ``inputs`` (src, x)."""
    y: Column = activation(F.sum(F.col("w") * F.col("x")), function)
    return weights.join(inputs, "src").groupBy("dst").agg((y if decimals is None else F.round(y, decimals)).alias("y"))

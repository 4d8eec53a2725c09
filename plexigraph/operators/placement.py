"""Placement of nodes on shards."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..model import Snapshot


def by_hash(snap: Snapshot, shards: int) -> DataFrame:
    """(handle, shard)."""
    return snap.nodes.rows.select("handle", F.pmod(F.xxhash64("handle"), F.lit(shards)).cast("int").alias("shard"))


def round_robin(snap: Snapshot, shards: int) -> DataFrame:
    """(handle, shard) in turn, by handle order: balanced to one node.

    Ranks come from range partitions and their counts, not from one sorted task.
    """
    ranged = snap.nodes.rows.select("handle").repartitionByRange("handle").sortWithinPartitions("handle")
    numbered = ranged.withColumn("id", F.monotonically_increasing_id())
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND((1 << 33) - 1)
    numbered = numbered.withColumn("part", part).withColumn("row", row)
    sizes = {r["part"]: r["n"] for r in numbered.groupBy("part").agg(F.count("*").alias("n")).collect()}  # a row per task
    start, at = {}, 0
    for p in sorted(sizes):
        start[p], at = at, at + sizes[p]
    if not start:
        return numbered.select("handle", F.lit(0).alias("shard"))
    offset = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in start.items() for x in kv]), F.col("part"))
    return numbered.select("handle", F.pmod(offset + F.col("row"), F.lit(shards)).cast("int").alias("shard"))


def greedy(snap: Snapshot, shards: int, placed: DataFrame | None = None, clustered: bool = False, weight: str | None = None, slack: float = 1.1) -> DataFrame:
    """(handle, shard): linear deterministic greedy streaming placement.

    Nodes come in handle order, each to the shard with the most of its out-neighbours,
    damped by how full it is: neighbours * (1 - size / (slack * total / 1)); a tie goes to
    the smaller shard.  ``clustered`` weighs a neighbour by log(2 + mutual neighbours);
    ``weight`` names an edge property to weigh by.  The algorithm is sequential by definition:
    one task streams over adjacency rows and holds a shard number per node.
    """
    e = snap.edges.rows.filter("src != dst")
    if weight is not None:
        if weight in snap.edges.wide:
            w = e.select("src", "dst", F.col(snap.edges.wide[weight]).cast("string").try_cast("double").alias("w"))
        else:
            w = e.select("handle", "src", "dst").join(snap.edges.value(weight), "handle").select("src", "dst", F.col("value").try_cast("double").alias("w"))
    elif clustered:
        pairs = e.select("src", "dst").distinct()
        wedge = pairs.join(pairs.select(F.col("src").alias("dst"), F.col("dst").alias("far")), "dst").select("src", F.col("far").alias("dst"))
        mutual = wedge.groupBy("src", "dst").agg(F.count("*").alias("m"))
        w = pairs.join(mutual, ["src", "dst"], "left").select("src", "dst", F.log(F.coalesce("m", F.lit(0)) + 2).alias("w"))
    else:
        w = e.select("src", "dst").distinct().withColumn("w", F.lit(1.0))
    adjacent = w.groupBy(F.col("src").alias("handle")).agg(F.sort_array(F.collect_list(F.struct("dst", F.coalesce("w", F.lit(0.0)).alias("w")))).alias("nbrs"))
    rows = snap.nodes.rows.select("handle").join(adjacent, "handle", "left")
    old = placed if placed is not None else by_hash(snap, shards)
    rows = rows.join(old.select("handle", F.col("shard").alias("old")), "handle", "left")
    total = snap.nodes.rows.count()
    room = max(slack * total, 1.0)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at: dict[str, int] = {}
        size = [0] * shards
        for b in batches:
            chosen = []
            for handle, nbrs, was in zip(b["handle"], b["nbrs"], b["old"], strict=True):
                near = [0.0] * shards
                for n in nbrs if nbrs is not None else ():
                    if (s := at.get(n["dst"])) is not None:
                        near[s] += n["w"]
                scores = [near[s] * (1 - size[s] / room) for s in range(shards)]
                stay = -1 if was is None or math.isnan(was) else int(was)
                best = min(range(shards), key=lambda s: (-scores[s], s != stay if scores[s] else size[s], size[s], s))
                at[handle] = best
                size[best] += 1
                chosen.append(best)
            yield pd.DataFrame({"handle": b["handle"], "shard": chosen})

    return rows.coalesce(1).sortWithinPartitions("handle").mapInPandas(run, "handle string, shard int")


def edge_cut(snap: Snapshot, placed: DataFrame) -> DataFrame:
    """(n, cut): all edges, and those whose ends are on different shards."""
    a, b = placed.select(F.col("handle").alias("src"), F.col("shard").alias("sa")), placed.select(F.col("handle").alias("dst"), F.col("shard").alias("sb"))
    both = snap.edges.rows.select("src", "dst").join(a, "src").join(b, "dst")
    return both.agg(F.count("*").alias("n"), F.sum((F.col("sa") != F.col("sb")).cast("long")).alias("cut"))

"""Reachability, weighted paths, path discovery and enumeration.

Loops are frontier loops: each step joins the frontier to the edge table, which is
written once with the columns the loop needs.  Every step's result goes to the
shared scratch folder; the planner sees real sizes and broadcasts a small frontier.
Semantics are those of breadth-first levels, with ties to the smallest handle.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.predicates import Requirements
from ..model import Snapshot
from ..scratch import Scratch


def _pairs(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def levels(edges: DataFrame, starts: DataFrame, scratch: Scratch, max_hops: int | None = None, stop: str | None = None, paths: bool = False, blocked: Column | None = None) -> DataFrame:
    """(handle, hops[, path]): every node reached, at its least number of hops.

    ``edges`` has (src, dst); ``stop`` ends the loop when that node is reached;
    ``blocked`` nodes are reached but not expanded.  ``path`` runs from the node back to the
    start; of several it is the least.
    """
    first = starts.select("handle", F.lit(0).alias("hops"))
    if paths:
        first = first.withColumn("path", F.array("handle"))
    front = scratch.save(first.distinct(), "level0")
    seen, hops = [front], 0
    while max_hops is None or hops < max_hops:
        if front.isEmpty() or stop is not None and not front.filter(F.col("handle") == stop).isEmpty():
            break
        hops += 1
        open_ = front if blocked is None else front.filter(~blocked)
        step = open_.join(edges, open_["handle"] == edges["src"])
        if paths:
            step = step.select(F.col("dst").alias("handle"), F.concat(F.array("dst"), "path").alias("path")).groupBy("handle").agg(F.min("path").alias("path"))
        else:
            step = step.select(F.col("dst").alias("handle")).distinct()
        # one anti join with the union of all levels, however many there are
        step = step.join(_all(seen).select("handle"), "handle", "left_anti").withColumn("hops", F.lit(hops))
        front = scratch.save(step.select(*first.columns), f"level{hops}")
        seen.append(front)
    return _all(seen)


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def reach_set(snap: Snapshot, starts: DataFrame, props: Requirements = None, max_hops: int | None = None) -> DataFrame:
    """(handle, hops) of all nodes reachable from any start, starts included at 0."""
    scratch = Scratch(snap.spark, "reach")
    edges = scratch.save(_pairs(snap.edges_with(props)), "edges")
    return levels(edges, starts, scratch, max_hops)


def reach(snap: Snapshot, src: str, dst: str, props: Requirements = None, max_hops: int | None = None) -> DataFrame:
    """(reachable, hops, path): one row; the path lists dst first and src last.  Unreachable: false, null, null."""
    scratch = Scratch(snap.spark, "reach")
    edges = scratch.save(_pairs(snap.edges_with(props)), "edges")
    start = snap.nodes.rows.filter(F.col("handle") == src).select("handle")
    found = levels(edges, start, scratch, max_hops, stop=dst, paths=True).filter(F.col("handle") == dst)
    one = found.agg(F.count("*").alias("n"), F.min("hops").alias("hops"), F.min("path").alias("path"))
    return one.select((F.col("n") > 0).alias("reachable"), "hops", "path")


def pathless_reach(snap: Snapshot, src: str, dst: str, props: Requirements = None) -> bool:
    """Whether dst can be reached, without the path."""
    scratch = Scratch(snap.spark, "reach")
    edges = scratch.save(_pairs(snap.edges_with(props)), "edges")
    start = snap.nodes.rows.filter(F.col("handle") == src).select("handle")
    return not levels(edges, start, scratch, stop=dst).filter(F.col("handle") == dst).isEmpty()


def reaches(snap: Snapshot, dst: str, props: Requirements = None) -> DataFrame:
    """(handle): every node that reaches dst, itself included, by pointer doubling.

    Each round also squares the edge relation, so a chain of n edges takes log n
    rounds.  The squared relation may grow large on dense graphs: use
    :func:`reach_set` on reversed edges there.
    """
    scratch = Scratch(snap.spark, "double")
    hop = scratch.save(_pairs(snap.edges_with(props)), "hop0")
    found = scratch.save(snap.nodes.rows.filter(F.col("handle") == dst).select("handle"), "found0")
    k, n = 0, found.count()
    while True:
        k += 1
        more = hop.join(found, hop["dst"] == found["handle"]).select(F.col("src").alias("handle"))
        now = scratch.save(found.union(more).distinct(), f"found{k}")
        m = now.count()
        if m == n:
            return now
        right = hop.select(F.col("src").alias("dst"), F.col("dst").alias("far"))
        hop = scratch.save(hop.union(hop.join(right, "dst").select("src", F.col("far").alias("dst"))).distinct(), f"hop{k}")
        found, n = now, m


def best_costs(edges: DataFrame, src: str, widest: bool = False, paths: bool = False, spark=None) -> DataFrame:
    """(handle, cost[, path]): least sum of weights from src, or the widest bottleneck.

    ``edges`` has (src, dst, w long >= 0).  Only nodes whose cost improved in a step
    are expanded in the next.  The source costs 0; as a bottleneck it has none (null).
    """
    spark = spark or edges.sparkSession
    scratch = Scratch(spark, "costs")
    e = scratch.save(edges.groupBy("src", "dst").agg((F.max if widest else F.min)("w").alias("w")), "edges")
    key = lambda c: -F.col(c) if widest else F.col(c)

    def settle(parts: list[DataFrame]) -> DataFrame:
        """The best cost and path of each node over all steps."""
        best = _all(parts).groupBy("handle").agg(F.min(F.struct(key("cost").alias("k"), "path")).alias("b"))
        return best.select("handle", key("b.k").alias("cost"), F.col("b.path").alias("path"))

    front = scratch.save(spark.createDataFrame([(src, None if widest else 0, [src])], "handle string, cost long, path array<string>"), "front0")
    fronts, step = [front], 0
    while not front.isEmpty():
        step += 1
        f = front.withColumnRenamed("handle", "at")
        cost = F.when(F.col("cost").isNull(), F.col("w")).otherwise(F.least("cost", "w")) if widest else F.col("cost") + F.col("w")
        way = F.concat("path", F.array("dst")) if paths else F.lit(None).cast("array<string>")
        moved = f.join(e, f["at"] == e["src"]).filter(F.col("dst") != src).select(F.col("dst").alias("handle"), cost.alias("cost"), way.alias("path"))
        old = settle(fronts).select("handle", F.col("cost").alias("old"))
        better = settle([moved]).join(old, "handle", "left").filter(F.col("old").isNull() | (F.col("cost") > F.col("old") if widest else F.col("cost") < F.col("old")))
        front = scratch.save(better.select("handle", "cost", "path"), f"front{step}")
        fronts.append(front)
        if len(fronts) > 8:  # one table again, so that plans stay short
            fronts = [scratch.save(settle(fronts), f"known{step}")]
    known = settle(fronts)
    return known if paths else known.drop("path")


def weights(snap: Snapshot, key: str) -> DataFrame:
    """(src, dst, w): edges with an integer weight property; others are left out."""
    if key in snap.edges.wide:
        rows = snap.edges.rows.select("src", "dst", F.col(snap.edges.wide[key]).cast("string").alias("value"))
    else:
        rows = snap.edges.rows.select("handle", "src", "dst").join(snap.edges.value(key), "handle")
    return rows.select("src", "dst", F.trim("value").try_cast("bigint").alias("w")).filter("w is not null")


def weighted_path(snap: Snapshot, src: str, dst: str, key: str, widest: bool = False) -> DataFrame:
    """(cost, path): the cheapest (or widest) path from src to dst; unreachable: 0 and the empty path."""
    found = best_costs(weights(snap, key), src, widest, paths=True).filter(F.col("handle") == dst)
    one = found.agg(F.min("cost").alias("cost"), F.min("path").alias("path"))
    return one.select(F.coalesce("cost", F.lit(0)).alias("cost"), F.coalesce("path", F.array().cast("array<string>")).alias("path"))


# -- path discovery ----------------------------------------------------------------


def _usable(snap: Snapshot, node_preds: Requirements, edge_preds: Requirements, keep_dst: str | None, branching: int | None, by: str | None, random_seed: int | None) -> DataFrame:
    rows = snap.edges.having(edge_preds)
    if node_preds:
        ends = snap.nodes.having(node_preds).select(F.col("handle").alias("end"))
        for side in ("src", "dst"):
            rows = rows.join(ends, rows[side] == ends["end"], "left_semi")
    if branching:
        if by is not None:
            value = F.col(snap.edges.wide[by]).cast("string") if by in snap.edges.wide else F.col("__value")
            if by not in snap.edges.wide:
                rows = rows.join(snap.edges.value(by).withColumnRenamed("value", "__value"), "handle")
            key = F.coalesce(F.regexp_extract(value, r"^\s*([+-]?\d+)", 1).try_cast("int"), F.lit(0)).desc()
        else:
            key = F.xxhash64(F.lit(random_seed or 0), "handle").asc()
        first = (F.col("dst") != keep_dst).cast("int") if keep_dst else F.lit(0)
        rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy(first, key, "handle"))).filter(F.col("r") <= branching)
    return rows.select("handle", "src", "dst")


def discover_paths(snap: Snapshot, src: str, dst: str | None, path_len: int | None = None, node_preds: Requirements = None, edge_preds: Requirements = None, branching: int | None = None, branching_property: str | None = None, seed: int | None = None) -> DataFrame:
    """(handle, src, dst): the edges on walks src -> dst of at most ``path_len`` edges.

    All nodes and edges of a walk satisfy the predicates and dst is never passed through.  Two
    breadth-first searches give each node's distance from src and to dst; an edge is on such a
    walk iff the two and itself fit into path_len.  Without dst: the edges on walks of
    exactly ``path_len`` edges.  ``branching`` keeps that many edges of a node: those
    to dst first, then by the integer property (descending), or at random by seed.
    """
    scratch = Scratch(snap.spark, "discover")
    edges = scratch.save(_usable(snap, node_preds, edge_preds, dst, branching, branching_property, seed), "edges")
    start = snap.nodes.having(node_preds).filter(F.col("handle") == src).select("handle")
    if dst is None:
        if path_len is None:
            raise ValueError("a path length is needed without a destination")
        return _exact(edges, start, path_len, scratch)
    pairs = _pairs(edges)
    stop = F.col("handle") == dst
    ahead = levels(pairs, start, Scratch(snap.spark, "ahead"), path_len, blocked=stop)
    back = pairs.filter(F.col("src") != dst).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    end = snap.nodes.having(node_preds).filter(stop).select("handle")
    behind = levels(back, end, Scratch(snap.spark, "behind"), path_len)
    a = ahead.filter(~stop).select(F.col("handle").alias("src"), F.col("hops").alias("h"))
    b = behind.select(F.col("handle").alias("dst"), F.col("hops").alias("t"))
    on = edges.join(a, "src").join(b, "dst")
    if path_len is not None:
        on = on.filter(F.col("h") + 1 + F.col("t") <= path_len)
    return on.select("handle", "src", "dst")


def _exact(edges: DataFrame, start: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """Edges on walks of exactly n edges: layers forward, then pruned backward."""
    steps, front = [], start
    for i in range(n):
        step = scratch.save(edges.join(front.withColumnRenamed("handle", "src"), "src", "left_semi"), f"step{i}")
        steps.append(step)
        front = step.select(F.col("dst").alias("handle")).distinct()
    out, live = None, None
    for i in range(n - 1, -1, -1):
        step = steps[i] if live is None else steps[i].join(live, "dst", "left_semi")
        live = step.select(F.col("src").alias("dst")).distinct()
        out = step if out is None else out.unionByName(step)
    return edges.limit(0) if out is None else out.select("handle", "src", "dst").distinct()


def enumerate_paths(edges: DataFrame, src: str, dst: str, path_len: int, branch: Column | None = None) -> DataFrame:
    """(path array, edges array): the simple paths src -> dst of at most ``path_len`` edges.

    The number of paths may be exponential in ``path_len``; callers bound it, and pass edges that
    :func:`discover_paths` has pruned, so that every prefix can still arrive.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "enumerate")
    e = scratch.save(edges.select(F.col("handle").alias("edge"), F.col("src").alias("from"), "dst"), "edges")
    front = spark.createDataFrame([(src, [src], [])], "handle string, path array<string>, edges array<string>")
    done = []
    for i in range(path_len):
        step = front.join(e, front["handle"] == e["from"]).filter(~F.array_contains("path", F.col("dst")))
        step = step.select(F.col("dst").alias("handle"), F.concat("path", F.array("dst")).alias("path"), F.concat("edges", F.array("edge")).alias("edges"))
        step = scratch.save(step, f"step{i}")
        done.append(step.filter(F.col("handle") == dst).select("path", "edges"))
        front = step.filter(F.col("handle") != dst)
        if front.isEmpty():
            break
    return _all(done) if done else spark.createDataFrame([], "path array<string>, edges array<string>")


def path_vertices(paths: DataFrame) -> DataFrame:
    """(pairs array<struct<start, end>>): each path as the ends of its edges."""
    return paths.select(F.transform(F.slice("path", 2, 1 << 30), lambda x, i: F.struct(F.get("path", i).alias("start"), x.alias("end"))).alias("pairs"))


def cause_and_effect(snap: Snapshot, src: str, dst: str, confidence: str, cutoff: float = 0.1, max_hops: int | None = None, node_preds: Requirements = None, edge_preds: Requirements = None, max_results: int | None = None) -> DataFrame:
    """(path, confidence): simple paths src -> dst whose edge confidences multiply.

    A path is expanded while its product is above ``cutoff``; dst is accepted whatever the
    product.  ``max_hops`` bounds the path's edges; by default only the cutoff ends the search, and a path
    is simple, so it ends.  An edge without a numeric confidence is not used.  ``max_results`` keeps the most
    confident ones.
    """
    scratch = Scratch(snap.spark, "confidence")
    usable = _usable(snap, node_preds, edge_preds, None, None, None, None)
    c = snap.edges.value(confidence)
    e = scratch.save(usable.join(c, "handle").select(F.col("src").alias("from"), "dst", F.col("value").try_cast("double").alias("c")).filter("c is not null"), "edges")
    front = snap.nodes.having(node_preds).filter(F.col("handle") == src).select("handle", F.array("handle").alias("path"), F.lit(1.0).alias("confidence"))
    done = []
    for i in itertools.count() if max_hops is None else range(max_hops):
        step = front.join(e, front["handle"] == e["from"]).filter(~F.array_contains("path", F.col("dst")))
        step = step.select(F.col("dst").alias("handle"), F.concat("path", F.array("dst")).alias("path"), (F.col("confidence") * F.col("c")).alias("confidence"))
        step = scratch.save(step.filter((F.col("handle") == dst) | (F.col("confidence") > cutoff)), f"step{i}")
        done.append(step.filter(F.col("handle") == dst).select("path", "confidence"))
        front = step.filter(F.col("handle") != dst)
        if front.isEmpty():
            break
    out = _all(done)
    return out if max_results is None else out.orderBy(F.col("confidence").desc(), "path").limit(max_results)

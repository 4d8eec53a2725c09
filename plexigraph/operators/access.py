"""Point and batch reads: nodes, edges, properties, counts."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..errors import NotFoundError
from ..functions.predicates import Requirements
from ..model import Graph, Snapshot, visible


def resolve(snap: Snapshot, names: Iterable[str]) -> DataFrame:
    """(handle) of the nodes that the names stand for: handles first, then aliases.

    A name that is neither raises NOTFOUND.
    """
    names = list(dict.fromkeys(names))
    found = snap.nodes.rows.filter(F.col("handle").isin(names)).select(F.col("handle").alias("name"), "handle", F.lit(0).alias("via"))
    if snap.aliases is not None:
        found = found.union(snap.aliases.filter(F.col("alias").isin(names)).select("alias", "handle", F.lit(1)))
    best = {}
    for r in found.collect():  # at most two rows a name
        if r["name"] not in best or r["via"] < best[r["name"]][0]:
            best[r["name"]] = (r["via"], r["handle"])
    if missing := [n for n in names if n not in best]:
        raise NotFoundError(f"no node or alias {missing[:5]}")
    return snap.spark.createDataFrame([(h,) for h in dict.fromkeys(h for _, h in best.values())], "handle string")


def get_nodes(snap: Snapshot, handles: DataFrame | None = None, props: bool = True, edges: bool = True, aliases: bool = True) -> DataFrame:
    """One row per node: handle and, as asked, properties, out_edges and aliases.

    ``properties`` is map<key, array<value>>; a branch that is not asked for is not planned.
    """
    rows = snap.nodes.rows.select("handle")
    if handles is not None:
        rows = rows.join(handles.select("handle"), "handle", "left_semi")
    out = rows
    if props:
        values = snap.nodes.properties(snap.nodes.rows if handles is None else snap.nodes.rows.join(handles.select("handle"), "handle", "left_semi"))
        lists = values.groupBy("handle", "key").agg(F.transform(F.sort_array(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("values"))
        maps = lists.groupBy("handle").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "values")))).alias("properties"))
        out = out.join(maps, "handle", "left")
    if edges:
        own = snap.edges.rows.groupBy(F.col("src").alias("handle")).agg(F.sort_array(F.collect_list(F.struct(F.col("handle"), F.col("dst")))).alias("out_edges"))
        out = out.join(own, "handle", "left")
    if aliases and snap.aliases is not None:
        out = out.join(snap.aliases.groupBy("handle").agg(F.sort_array(F.collect_set("alias")).alias("aliases")), "handle", "left")
    return out


def node_props(snap: Snapshot, handles: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(handle, key, value, ord); no keys: all."""
    rows = snap.nodes.rows if handles is None else snap.nodes.rows.join(handles.select("handle"), "handle", "left_semi")
    return snap.nodes.properties(rows, keys)


def edge_props(snap: Snapshot, rows: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(handle, key, value, ord) of edges."""
    return snap.edges.properties(rows, keys)


def get_edges(snap: Snapshot, src: list[str] | None = None, nbrs: list[str] | None = None, handles: list[str] | None = None, props: Requirements = None) -> DataFrame:
    """Edges that pass every filter given; an empty or absent filter passes all, unknown handles none."""
    rows = snap.edges.rows
    for col, values in (("src", src), ("dst", nbrs), ("handle", handles)):
        if values:
            rows = rows.filter(F.col(col).isin(list(values)))
    return snap.edges.having(props, rows)


def get_edge(snap: Snapshot, handle: str) -> tuple[str, str, str]:
    """(handle, src, dst) of exactly one edge; else NOTFOUND."""
    rows = snap.edges.rows.filter(F.col("handle") == handle).select("handle", "src", "dst").limit(2).collect()
    if len(rows) != 1:
        raise NotFoundError(f"{len(rows) or 'no'} edge {handle}")
    return tuple(rows[0])


def edge_exists(snap: Snapshot, handles: DataFrame) -> DataFrame:
    """(handle, exists)."""
    there = snap.edges.rows.select("handle", F.lit(True).alias("e")).distinct()
    return handles.join(there, "handle", "left").select("handle", F.coalesce("e", F.lit(False)).alias("exists"))


def edges_of(snap: Snapshot, rows: DataFrame | None = None) -> DataFrame:
    """(handle, start, end, properties): edges in client form."""
    rows = snap.edges.rows if rows is None else rows
    values = snap.edges.properties(rows).groupBy("handle").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("properties"))
    return rows.select("handle", F.col("src").alias("start"), F.col("dst").alias("end")).join(values, "handle", "left")


def edge_count(snap: Snapshot, props: Requirements = None) -> DataFrame:
    """(src, n) for every node with a matching out-edge."""
    return snap.edges.having(props).groupBy("src").agg(F.count("*").alias("n"))


def read_n_edges(snap: Snapshot, n: int, props: Requirements = None) -> DataFrame:
    """(src, handle, dst): each node's first n matching edges by handle; n = 0: all.

    The ranking is cut in every task before the shuffle.
    """
    rows = snap.edges.having(props).select("src", "handle", "dst")
    if n <= 0:
        return rows
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("src").orderBy("handle"))).filter(F.col("r") <= n).drop("r")


def edge_total(snap: Snapshot) -> DataFrame:
    """(n): the number of visible edges."""
    return snap.edges.rows.agg(F.count("*").alias("n"))


def node_count(snap: Snapshot, shards: int = 8, place: Column | None = None) -> DataFrame:
    """(shard, n), by hash placement or by another expression."""
    shard = F.pmod(F.xxhash64("handle"), F.lit(shards)) if place is None else place
    return snap.nodes.rows.groupBy(shard.alias("shard")).agg(F.count("*").alias("n"))


def has_aliases(snap: Snapshot, rows: DataFrame, aliases: Iterable[str]) -> DataFrame:
    """The rows whose node has every alias."""
    for a in aliases:
        if snap.aliases is None:
            return rows.filter(F.lit(False))
        rows = rows.join(snap.aliases.filter(F.col("alias") == a).select("handle"), "handle", "left_semi")
    return rows


def degree_histogram(snap: Snapshot, props: Requirements = None) -> DataFrame:
    """(degree, n): how many nodes have so many out-edges."""
    return edge_count(snap, props).groupBy(F.col("n").alias("degree")).agg(F.count("*").alias("n"))


def top_neighbors(snap: Snapshot, key: str, k: int) -> DataFrame:
    """(src, handle, dst, rank): each node's k edges of largest integer property, ties by handle; no number counts as 0."""
    number = F.coalesce(F.regexp_extract("value", r"^\s*([+-]?\d+)", 1).try_cast("bigint"), F.lit(0))
    if key in snap.edges.wide:
        rows = snap.edges.rows.select("src", "handle", "dst", F.col(snap.edges.wide[key]).cast("string").alias("value"))
    else:
        rows = snap.edges.rows.select("src", "handle", "dst").join(snap.edges.value(key), "handle")
    rows = rows.withColumn("w", number)
    order = Window.partitionBy("src").orderBy(F.col("w").desc(), "handle")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("src", "handle", "dst", "rank")


def random_neighbors(snap: Snapshot, k: int, seed: int = 42) -> DataFrame:
    """(src, handle, dst): k random edges of each node, the same on every run."""
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "handle"), "handle")
    return snap.edges.rows.select("src", "handle", "dst").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r")


def versions_at(graph: Graph, asked: DataFrame, edges: bool = False) -> DataFrame:
    """(handle, version, created_v) for each (handle, version) asked about at which the element is visible.

    The as-of lookup of many pairs at once: an equi-join on the handle, and the visibility
    rule with the version as a column.
    """
    rows = (graph.edges if edges else graph.nodes).rows.select("handle", "created_v", "deleted_v")
    return asked.join(rows, "handle").filter(visible(F.col("version"))).select("handle", "version", "created_v")

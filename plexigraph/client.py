"""The client: transactions and queries on a store."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Mapping
from types import TracebackType
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from .errors import ActiveTxError, LogicalError, NoActiveTxError, NoAuxIndexError, NotFoundError
from .functions.predicates import Requirements
from .model import Snapshot
from .operators import access, local, network, paths, phrases, placement, star, traverse, vertex
from .store import Store


class Client:
    """One client has at most one open transaction; reads see the last commit, or ``as_of``."""

    def __init__(self, spark: SparkSession, path: str, client_id: int = 0, aux_index: bool = True):
        self.store, self.id, self._aux = Store(spark, path), client_id, aux_index
        self._ops: list[tuple] | None = None
        self._names = itertools.count()
        self._tx = 0
        self.registry = vertex.Registry()

    # -- transactions ----------------------------------------------------------

    def begin_tx(self) -> Client:
        if self._ops is not None:
            raise ActiveTxError("a transaction is open")
        self._ops, self._tx = [], self._tx + 1
        return self

    def __enter__(self) -> Client:
        return self

    def __exit__(self, kind: type | None, error: BaseException | None, at: TracebackType | None) -> None:
        if self._ops is None:
            return
        if kind is None:
            self.end_tx()
        else:
            self.abort_tx()

    def _add(self, op: str, handle: str | None = None, handle1: str | None = None, handle2: str | None = None, alias1: str | None = None, alias2: str | None = None, key: str | None = None, value: Any = None) -> None:
        if self._ops is None:
            raise NoActiveTxError("no transaction is open")
        self._ops.append((self._tx, len(self._ops), op, handle, handle1, handle2, alias1, alias2, key, None if value is None else str(value)))

    def _name(self) -> str:
        return f"{next(self._names)}_{self.id}_{self.store.head}"

    def create_node(self, handle: str | None = None, aliases: Iterable[str] = ()) -> str:
        handle = handle or self._name()
        self._add("NODE_CREATE", handle)
        for a in aliases:
            self.add_alias(a, handle)
        return handle

    def create_edge(self, node1: str | None = None, node2: str | None = None, handle: str | None = None, *, alias1: str | None = None, alias2: str | None = None) -> str:
        handle = handle or self._name()
        self._add("EDGE_CREATE", handle, node1, node2, alias1, alias2)
        return handle

    def delete_node(self, handle: str | None = None, *, alias: str | None = None) -> None:
        self._add("NODE_DELETE", None, handle, None, alias)

    def delete_edge(self, edge: str, node: str | None = None, *, alias: str | None = None) -> None:
        self._add("EDGE_DELETE", edge, node, None, alias)

    def set_node_property(self, key: str, value: Any, node: str | None = None, *, alias: str | None = None) -> None:
        self._add("NODE_SET_PROPERTY", None, node, None, alias, None, key, value)

    def set_node_properties(self, props: Mapping[str, Any], node: str | None = None, *, alias: str | None = None) -> None:
        """One set per value: of a list only the last remains."""
        for k, vs in props.items():
            for v in vs if isinstance(vs, list) else [vs]:
                self.set_node_property(k, v, node, alias=alias)

    def set_edge_property(self, edge: str, key: str, value: Any, node: str | None = None, *, alias: str | None = None) -> None:
        self._add("EDGE_SET_PROPERTY", edge, node, None, alias, None, key, value)

    def set_edge_properties(self, edge: str, props: Mapping[str, Any], node: str | None = None, *, alias: str | None = None) -> None:
        for k, vs in props.items():
            for v in vs if isinstance(vs, list) else [vs]:
                self.set_edge_property(edge, k, v, node, alias=alias)

    def add_alias(self, alias: str, node: str) -> None:
        if not self._aux:
            raise NoAuxIndexError("aliases are switched off")
        self._add("ADD_ALIAS", None, node, None, alias)

    def end_tx(self) -> int:
        """Commits; the new commit number.  A violated rule raises ABORT and changes nothing."""
        if self._ops is None:
            raise NoActiveTxError("no transaction is open")
        ops, self._ops = self._ops, None
        return self.store.commit(ops)[0] if ops else self.store.head

    def abort_tx(self) -> None:
        if self._ops is None:
            raise NoActiveTxError("no transaction is open")
        self._ops = None

    # -- reads -------------------------------------------------------------------

    def snapshot(self, as_of: int | None = None) -> Snapshot:
        return self.store.at(as_of)

    def _one(self, snap: Snapshot, name: str) -> DataFrame:
        return access.resolve(snap, [name])

    def get_node(self, node: str, get_props: bool = True, get_edges: bool = True, get_aliases: bool = True, as_of: int | None = None) -> dict:
        snap = self.snapshot(as_of)
        row = access.get_nodes(snap, self._one(snap, node), get_props, get_edges, get_aliases).first()
        return row.asDict(recursive=True)

    def get_node_properties(self, node: str, as_of: int | None = None) -> dict[str, list[str]]:
        return self.get_node(node, True, False, False, as_of)["properties"] or {}

    def get_node_edges(self, node: str, as_of: int | None = None) -> list[dict]:
        return self.get_node(node, False, True, False, as_of)["out_edges"] or []

    def get_node_aliases(self, node: str, as_of: int | None = None) -> list[str]:
        return self.get_node(node, False, False, True, as_of)["aliases"] or []

    def read_node_props(self, node: str, keys: list[str] | None = None, as_of: int | None = None) -> list[tuple[str, str]]:
        snap = self.snapshot(as_of)
        return [(r["key"], r["value"]) for r in access.node_props(snap, self._one(snap, node), keys).orderBy("ord", "key", "value").collect()]

    def read_edges_props(self, node: str, keys: list[str] | None = None, as_of: int | None = None) -> DataFrame:
        snap = self.snapshot(as_of)
        mine = snap.edges.rows.join(self._one(snap, node).select(F.col("handle").alias("src")), "src", "left_semi")
        return access.edge_props(snap, mine, keys)

    def get_edges(self, node: str, nbrs: list[str] | None = None, edges: list[str] | None = None, properties: Requirements = None, as_of: int | None = None) -> DataFrame:
        snap = self.snapshot(as_of)
        src = [r[0] for r in self._one(snap, node).collect()]
        return access.edges_of(snap, access.get_edges(snap, src, nbrs, edges, properties))

    def get_edge(self, edge: str, as_of: int | None = None) -> dict:
        snap = self.snapshot(as_of)
        rows = access.edges_of(snap, snap.edges.rows.filter(F.col("handle") == edge)).limit(2).collect()
        if len(rows) != 1:
            raise NotFoundError(f"edge {edge}")
        return rows[0].asDict(recursive=True)

    def edge_count(self, node: str, properties: Requirements = None, as_of: int | None = None) -> int:
        snap = self.snapshot(as_of)
        rows = snap.edges.rows.join(self._one(snap, node).select(F.col("handle").alias("src")), "src", "left_semi")
        return snap.edges.having(properties, rows).count()

    def read_n_edges(self, node: str, n: int, properties: Requirements = None, as_of: int | None = None) -> list[str]:
        snap = self.snapshot(as_of)
        rows = snap.edges.rows.join(self._one(snap, node).select(F.col("handle").alias("src")), "src", "left_semi")
        found = snap.edges.having(properties, rows).select("handle").orderBy("handle")
        return [r[0] for r in (found.limit(n) if n > 0 else found).collect()]

    def get_node_count(self, as_of: int | None = None) -> int:
        return self.snapshot(as_of).nodes.rows.count()

    @property
    def aux_index(self) -> bool:
        return self._aux

    # -- programs ------------------------------------------------------------------

    def traverse(self, starts: Any, props: Requirements = None, aliases: Iterable[str] = (), as_of: int | None = None) -> traverse.Traversal:
        return traverse.Traversal(self.snapshot(as_of), starts, props, aliases)

    def traverse_props(self, starts: Any, node_props: list, edge_props: list, node_aliases: list | None = None, collect_nodes: bool = False, collect_edges: bool = False, as_of: int | None = None) -> DataFrame:
        return traverse.traverse_props(self.snapshot(as_of), starts, node_props, edge_props, node_aliases, collect_nodes, collect_edges)

    def reach(self, src: str, dst: str, props: Requirements = None, max_hops: int | None = None, as_of: int | None = None) -> dict:
        return paths.reach(self.snapshot(as_of), src, dst, props, max_hops).first().asDict()

    def pathless_reach(self, src: str, dst: str, props: Requirements = None, as_of: int | None = None) -> bool:
        return paths.pathless_reach(self.snapshot(as_of), src, dst, props)

    def n_hop_reach(self, src: str, dst: str, max_hops: int, as_of: int | None = None) -> dict:
        return self.reach(src, dst, None, max_hops, as_of)

    def shortest_path(self, src: str, dst: str, weight: str, as_of: int | None = None) -> dict:
        return paths.weighted_path(self.snapshot(as_of), src, dst, weight).first().asDict()

    def widest_path(self, src: str, dst: str, weight: str, as_of: int | None = None) -> dict:
        return paths.weighted_path(self.snapshot(as_of), src, dst, weight, True).first().asDict()

    def clustering(self, node: str, as_of: int | None = None) -> float:
        """The coefficient of one node; only wedges of that node are joined."""
        snap = self.snapshot(as_of)
        center = self._one(snap, node).first()[0]
        e = snap.edges.rows.filter("src != dst").select("src", "dst")
        own = e.filter(F.col("src") == center)
        near = own.select(F.col("dst").alias("n")).distinct()
        k = near.count()
        closed = own.join(e.select(F.col("src").alias("dst"), F.col("dst").alias("n")), "dst").join(near, "n", "left_semi").count()
        return closed / (k * (k - 1)) if k > 1 else 0.0

    def two_neighborhood(self, node: str, key: str, as_of: int | None = None) -> list[tuple[str, str]]:
        snap = self.snapshot(as_of)
        return sorted((r["node"], r["value"]) for r in local.two_neighborhood(snap, key, self._one(snap, node)).collect())

    def discover_paths(self, src: str, dst: str | None, as_of: int | None = None, **options: Any) -> DataFrame:
        return paths.discover_paths(self.snapshot(as_of), src, dst, **options)

    def enumerate_paths(self, edges: DataFrame, src: str, dst: str, path_len: int) -> DataFrame:
        return paths.enumerate_paths(edges, src, dst, path_len)

    def enumerate_path_vertices(self, found: DataFrame) -> DataFrame:
        return paths.path_vertices(found)

    def cause_and_effect(self, src: str, dst: str, confidence: str, as_of: int | None = None, **options: Any) -> DataFrame:
        return paths.cause_and_effect(self.snapshot(as_of), src, dst, confidence, **options)

    def n_gram_path(self, words: list[str], preds: Requirements = None, as_of: int | None = None) -> DataFrame:
        return phrases.phrase(phrases.occurrences(self.snapshot(as_of), preds), words)

    def get_btc_block(self, block: str, as_of: int | None = None) -> dict:
        snap = self.snapshot(as_of)
        return star.get_block(snap, self._one(snap, block)).first().asDict()

    def get_btc_tx(self, tx: str, as_of: int | None = None) -> DataFrame:
        snap = self.snapshot(as_of)
        return star.get_tx(snap, self._one(snap, tx))

    def get_btc_addr(self, address: str, as_of: int | None = None) -> DataFrame:
        snap = self.snapshot(as_of)
        return star.get_address(snap, self._one(snap, address))

    def nn_infer(self, start: str, end: str, values: list[float], function: str = "", as_of: int | None = None) -> list[float]:
        return network.infer(self.snapshot(as_of), start, end, values, function)

    def register_node_prog(self, compute: vertex.Compute) -> str:
        return self.registry.register(compute)

    def run_node_prog(self, program: str, starts: list[tuple[str, Any]], params: Any = None, as_of: int | None = None, **options: Any) -> DataFrame:
        return self.registry.run(program, self.snapshot(as_of), starts, params, **options)

    def single_stream_migration(self, shards: int = 8) -> DataFrame:
        """(handle, shard): a placement that cuts few edges."""
        if shards < 1:
            raise LogicalError("at least one shard")
        return placement.greedy(self.snapshot(), shards)

    start_migration = single_stream_migration

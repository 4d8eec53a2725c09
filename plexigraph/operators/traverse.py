"""Fluent multi-hop traversal: node, edge, node, ... levels with requirements."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from ..errors import LogicalError
from ..functions.predicates import Requirements
from ..model import Snapshot
from ..scratch import Scratch
from .access import has_aliases, resolve


class Traversal:
    """``Traversal(snap, starts, props).out_edge(props).node(props)....execute()``.

    A node counts at the earliest level that reaches it, whether it passes there or not.
    Plans of more than CUT hops are cut by scratch tables.
    """

    CUT = 4

    def __init__(self, snap: Snapshot, starts: DataFrame | str | Iterable[str], props: Requirements = None, aliases: Iterable[str] = ()):
        self.snap = snap
        if isinstance(starts, DataFrame):
            self.starts = starts.select("handle")
        else:
            self.starts = resolve(snap, [starts] if isinstance(starts, str) else starts)
        self.levels: list[tuple[str, Requirements, tuple[str, ...]]] = [("node", props, tuple(aliases))]

    def out_edge(self, props: Requirements = None) -> Traversal:
        if self.levels[-1][0] == "edge":
            raise LogicalError("two edge levels in a row")
        self.levels.append(("edge", props, ()))
        return self

    def node(self, props: Requirements = None, aliases: Iterable[str] = ()) -> Traversal:
        if self.levels[-1][0] == "node":
            raise LogicalError("two node levels in a row")
        self.levels.append(("node", props, tuple(aliases)))
        return self

    def execute(self, collect_nodes: bool = False, collect_edges: bool = False) -> DataFrame:
        """(kind, handle), distinct: the last level, and as asked all accepted nodes and matching edges.

        A traversal may end on an edge level; then its edges are the result.
        """
        snap, scratch = self.snap, Scratch(self.snap.spark, "traverse")
        reached, seen, parts, edges = self.starts, None, [], None
        hops = 0
        for i, (kind, props, aliases) in enumerate(self.levels):
            last = i == len(self.levels) - 1
            if kind == "node":
                fresh = reached.distinct() if seen is None else reached.distinct().join(seen, "handle", "left_anti")
                if hops > self.CUT:
                    fresh, hops = scratch.save(fresh, f"level{i}"), 0
                seen = fresh if seen is None else seen.union(fresh)
                # the node table comes in only where it can change the result
                own = snap.nodes.rows.join(fresh, "handle", "left_semi") if props or i == 0 else fresh
                accepted = has_aliases(snap, snap.nodes.having(props, own), aliases).select("handle")
                if last or collect_nodes:
                    parts.append(accepted.select(F.lit("node").alias("kind"), "handle"))
            else:
                matching = snap.edges.having(props)
                edges = matching.join(accepted.select(F.col("handle").alias("at")), matching["src"] == F.col("at"), "left_semi")
                if last or collect_edges:
                    parts.append(edges.select(F.lit("edge").alias("kind"), "handle"))
                reached = edges.select(F.col("dst").alias("handle"))
                hops += 1
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out.distinct()

    def collect(self) -> DataFrame:
        """Accepted nodes and matching edges of all levels."""
        return self.execute(True, True)

    def collect_nodes(self) -> DataFrame:
        return self.execute(collect_nodes=True)

    def collect_edges(self) -> DataFrame:
        return self.execute(collect_edges=True)


def traverse_props(snap: Snapshot, starts: DataFrame | str | Iterable[str], node_props: list[Requirements], edge_props: list[Requirements], node_aliases: list[Iterable[str]] | None = None, collect_nodes: bool = False, collect_edges: bool = False) -> DataFrame:
    """The list form of a traversal; as many edge levels as node levels, or one fewer."""
    if len(node_props) - len(edge_props) not in (0, 1):
        raise LogicalError("edge levels must be as many as node levels, or one fewer")
    aliases = node_aliases or [()] * len(node_props)
    t = Traversal(snap, starts, node_props[0], aliases[0])
    for i, e in enumerate(edge_props):
        t.out_edge(e)
        if i + 1 < len(node_props):
            t.node(node_props[i + 1], aliases[i + 1])
    return t.execute(collect_nodes, collect_edges)

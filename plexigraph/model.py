"""The data model: versioned elements, their properties, and snapshots.

Every row has ``created_v`` and ``deleted_v`` (null: not deleted).  It is
visible at version v iff created_v < v and (deleted_v is null or v < deleted_v).

Properties come in two layouts, which may be mixed: *long* rows (handle, key,
value, ord), which allow several values for a key and need a semi join per
predicate, and *wide* columns of the element's own row, one value per key, whose
predicates become plain filters that reach the scan.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .functions.predicates import Pred, Requirements, predicates

VERSIONS = "created_v BIGINT, deleted_v BIGINT"
NODES = f"handle STRING, {VERSIONS}"
EDGES = f"handle STRING, src STRING, dst STRING, {VERSIONS}"
PROPS = f"handle STRING, key STRING, value STRING, ord BIGINT, {VERSIONS}"
ALIASES = f"alias STRING, handle STRING, {VERSIONS}"
TABLES = {"nodes": NODES, "edges": EDGES, "node_props": PROPS, "edge_props": PROPS, "aliases": ALIASES}


def visible(version: int | Column) -> Column:
    """The visibility rule at a version."""
    v = F.lit(version) if isinstance(version, int) else version
    return (F.col("created_v") < v) & (F.col("deleted_v").isNull() | (F.col("deleted_v") > v))


@dataclass(frozen=True)
class Elements:
    """Nodes or edges with their properties.

    ``wide`` maps property keys to columns of ``rows``.
    """

    rows: DataFrame
    props: DataFrame | None = None
    wide: dict[str, str] = field(default_factory=dict)

    def at(self, version: int) -> Elements:
        return replace(self, rows=self.rows.filter(visible(version)), props=None if self.props is None else self.props.filter(visible(version)))

    def having(self, req: Requirements, rows: DataFrame | None = None) -> DataFrame:
        """The rows (of ``rows``, by default all) that satisfy every requirement.

        Each predicate asks for *some* value of its key, so with several values two
        predicates on one key may be satisfied by different ones: one semi join each.
        """
        out = self.rows if rows is None else rows
        for p in predicates(req):
            if p.key in self.wide:
                out = out.filter(p.test(F.col(self.wide[p.key]).cast("string")))
            elif self.props is not None:
                out = out.join(self.props.filter((F.col("key") == p.key) & p.test(F.col("value"))).select("handle"), "handle", "left_semi")
            else:
                out = out.filter(F.lit(False))
        return out

    def properties(self, rows: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
        """(handle, key, value, ord) of the rows; ``keys`` empty or None: all keys."""
        rows = self.rows if rows is None else rows
        parts = []
        wide = {k: c for k, c in self.wide.items() if not keys or k in keys}
        if wide:
            pairs = F.array(*[F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"), F.lit(i).cast("bigint").alias("ord")) for i, (k, c) in enumerate(wide.items())])
            parts.append(rows.select("handle", F.explode(pairs).alias("p")).select("handle", "p.*").filter("value is not null"))
        if self.props is not None:
            long = self.props if not keys else self.props.filter(F.col("key").isin(*keys))
            parts.append(long.join(rows.select("handle").distinct(), "handle", "left_semi").select("handle", "key", "value", "ord"))
        if not parts:
            return rows.sparkSession.createDataFrame([], "handle string, key string, value string, ord bigint")
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    def value(self, key: str, rows: DataFrame | None = None) -> DataFrame:
        """(handle, value): the first value of a key, ``''`` where there is none."""
        rows = self.rows if rows is None else rows
        if key in self.wide:
            return rows.select("handle", F.coalesce(F.col(self.wide[key]).cast("string"), F.lit("")).alias("value"))
        first = self.properties(rows, [key]).groupBy("handle").agg(F.min_by("value", "ord").alias("value"))
        return rows.select("handle").join(first, "handle", "left").select("handle", F.coalesce("value", F.lit("")).alias("value"))


@dataclass(frozen=True)
class Graph:
    """All versions of a graph.

    ``closed`` promises that no edge's end is ever missing or deleted while the edge is
    visible, which saves a snapshot two semi joins.
    """

    nodes: Elements
    edges: Elements
    aliases: DataFrame | None = None
    closed: bool = False

    @property
    def spark(self) -> SparkSession:
        return self.nodes.rows.sparkSession

    def at(self, version: int) -> Snapshot:
        """The graph as visible at a version.  An edge needs both its ends."""
        nodes, edges = self.nodes.at(version), self.edges.at(version)
        if not self.closed:
            ends = nodes.rows.select(F.col("handle").alias("end"))
            both = edges.rows
            for side in ("src", "dst"):
                both = both.join(ends, both[side] == ends["end"], "left_semi")
            edges = replace(edges, rows=both)
        aliases = None if self.aliases is None else self.aliases.filter(visible(version)).join(nodes.rows.select("handle"), "handle", "left_semi")
        return Snapshot(version, nodes, edges, aliases)

    def changes(self, after: int, upto: int) -> DataFrame:
        """(handle, kind, change): elements and properties created or deleted in (after, upto]."""
        parts = []
        for kind, df in (("node", self.nodes.rows), ("edge", self.edges.rows), ("node_prop", self.nodes.props), ("edge_prop", self.edges.props)):
            if df is not None:
                for change, col in (("created", "created_v"), ("deleted", "deleted_v")):
                    parts.append(df.filter((F.col(col) > after) & (F.col(col) <= upto)).select("handle", F.lit(kind).alias("kind"), F.lit(change).alias("change")))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def compact(self, low: int) -> Graph:
        """Without the versions that no reader at ``low`` or later can see."""
        keep = F.col("deleted_v").isNull() | (F.col("deleted_v") > low)
        trim = lambda e: replace(e, rows=e.rows.filter(keep), props=None if e.props is None else e.props.filter(keep))
        return replace(self, nodes=trim(self.nodes), edges=trim(self.edges), aliases=None if self.aliases is None else self.aliases.filter(keep))


@dataclass(frozen=True)
class Snapshot:
    """One consistent version of a graph."""

    version: int
    nodes: Elements
    edges: Elements
    aliases: DataFrame | None = None

    @property
    def spark(self) -> SparkSession:
        return self.nodes.rows.sparkSession

    def views(self, prefix: str) -> None:
        """Registers the tables for SQL: <prefix>_nodes, _edges, _node_props, _edge_props and _aliases."""
        self.nodes.rows.createOrReplaceTempView(f"{prefix}_nodes")
        self.edges.rows.createOrReplaceTempView(f"{prefix}_edges")
        self.nodes.properties().createOrReplaceTempView(f"{prefix}_node_props")
        self.edges.properties().createOrReplaceTempView(f"{prefix}_edge_props")
        if self.aliases is not None:
            self.aliases.createOrReplaceTempView(f"{prefix}_aliases")

    def edges_with(self, req: Requirements = None) -> DataFrame:
        """(handle, src, dst) of the edges that satisfy the requirements."""
        return self.edges.having(req).select("handle", "src", "dst")


def frame(spark: SparkSession, table: str, rows: list[tuple]) -> DataFrame:
    """A table of the model from Python rows; version columns may be left out (0, null)."""
    width = len(TABLES[table].split(", "))
    return spark.createDataFrame([(*r, *(0, None)[len(r) - width :]) if len(r) < width else r for r in rows], TABLES[table])


def graph_of(spark: SparkSession, nodes: list[str], edges: list[tuple[str, str, str]], node_props: list[tuple[str, str, str]] = (), edge_props: list[tuple[str, str, str]] = (), aliases: list[tuple[str, str]] = ()) -> Graph:
    """A small graph at version 0, for tests and examples."""
    props = lambda rows: [(h, k, v, i) for i, (h, k, v) in enumerate(rows)]
    return Graph(
        Elements(frame(spark, "nodes", [(n,) for n in nodes]), frame(spark, "node_props", props(node_props))),
        Elements(frame(spark, "edges", list(edges)), frame(spark, "edge_props", props(edge_props))),
        frame(spark, "aliases", list(aliases)),
    )


__all__ = ["ALIASES", "EDGES", "NODES", "PROPS", "TABLES", "Elements", "Graph", "Pred", "Snapshot", "frame", "graph_of", "visible"]

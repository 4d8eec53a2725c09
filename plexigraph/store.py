"""A transactional store: an append-only version log on Parquet.

Commit number c stamps what it creates and deletes with 2 c; a reader after commit c reads
at 2 c + 1, strictly between two commits.  A commit writes its new rows and its tombstones into
a folder of its own and then publishes a manifest file by a rename that fails if the
number is taken, so a crash leaves a folder nobody reads and two writers cannot both win.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .errors import AbortedError, LogicalError, TakenError
from .model import TABLES, Elements, Graph, Snapshot
from .scratch import Scratch

OPS = "tx_id BIGINT, seq INT, op STRING, handle STRING, handle1 STRING, handle2 STRING, alias1 STRING, alias2 STRING, key STRING, value STRING"
KEYS = {"nodes": ["handle"], "edges": ["handle"], "node_props": ["handle", "key", "value"], "edge_props": ["handle", "key", "value"], "aliases": ["alias", "handle"]}
#: Rounds in which a batch may shed conflicting transactions.
ROUNDS = 1000
CLOSED = "handle STRING, key STRING, value STRING, alias STRING, created_v BIGINT, closed_v BIGINT"


@dataclass
class Plan:
    """What a batch of transactions changes: rows to add and rows to close, by table."""

    added: dict[str, DataFrame]
    closed: dict[str, DataFrame]


def _resolve(ops: DataFrame, snap: Snapshot) -> DataFrame:
    """Fills handle1 and handle2 from aliases: of the snapshot, or added earlier in the batch."""
    known = ops.filter("op = 'ADD_ALIAS'").select(F.col("alias1").alias("alias"), F.col("handle1").alias("target"), F.col("at").alias("since"))
    if snap.aliases is not None:
        known = known.unionByName(snap.aliases.select("alias", F.col("handle").alias("target"), F.lit(-1).cast("bigint").alias("since")))
    for n in ("1", "2"):
        hits = ops.filter(F.col(f"handle{n}").isNull() & F.col(f"alias{n}").isNotNull()).select("at", F.col(f"alias{n}").alias("alias"))
        found = hits.join(known, "alias").filter("since < at").groupBy("at").agg(F.max_by("target", "since").alias("target"))
        ops = ops.join(found, "at", "left").withColumn(f"handle{n}", F.coalesce(f"handle{n}", "target")).drop("target")
    return ops


def _events(ops: DataFrame) -> DataFrame:
    """(kind, handle, at, tx_id, need, set): what each operation asks of elements and does to them."""

    def rows(cond: str, kind: str, handle: str, need: int | None, set_: int | None) -> DataFrame:
        return ops.filter(cond).select(F.lit(kind).alias("kind"), F.col(handle).alias("handle"), "at", "tx_id", F.lit(need).cast("int").alias("need"), F.lit(set_).cast("int").alias("set"))

    parts = [
        rows("op = 'NODE_CREATE'", "n", "handle", 0, 1),
        rows("op = 'NODE_DELETE'", "n", "handle1", 1, 0),
        rows("op in ('NODE_SET_PROPERTY', 'ADD_ALIAS')", "n", "handle1", 1, None),
        rows("op = 'EDGE_CREATE'", "n", "handle1", 1, None),
        rows("op = 'EDGE_CREATE'", "n", "handle2", 1, None),
        rows("op = 'EDGE_CREATE'", "e", "handle", 0, 1),
        rows("op = 'EDGE_DELETE'", "e", "handle", 1, 0),
        rows("op = 'EDGE_SET_PROPERTY'", "e", "handle", 1, None),
        rows("op = 'ADD_ALIAS'", "a", "alias1", 0, 1),
        # an alias must not be the handle of a live node
        rows("op = 'ADD_ALIAS'", "n", "alias1", 0, None),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def violations(ops: DataFrame, snap: Snapshot) -> DataFrame:
    """(kind, handle, at, tx_id): operations that break a rule, given those before them.

    ``ops`` is resolved and has the global order ``at``.  The state of an element before an
    operation is the last one set by the snapshot or an earlier operation: one window per element.
    """
    events = _events(ops)
    touched = events.select("kind", "handle").distinct()

    def now(kind: str, rows: DataFrame, key: str) -> DataFrame:
        mine = touched.filter(F.col("kind") == kind).select(F.col("handle").alias(key))
        return rows.join(mine, key, "left_semi").select(F.lit(kind).alias("kind"), F.col(key).alias("handle"), F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("tx_id"), F.lit(None).cast("int").alias("need"), F.lit(1).alias("set")).distinct()

    start = now("n", snap.nodes.rows, "handle").unionByName(now("e", snap.edges.rows, "handle"))
    if snap.aliases is not None:
        start = start.unionByName(now("a", snap.aliases, "alias"))
    w = Window.partitionBy("kind", "handle").orderBy("at", F.col("set").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    state = F.coalesce(F.last("set", ignorenulls=True).over(w), F.lit(0))
    # a self-loop edge and the like put two rows at one place; only other operations count as before
    bad = start.unionByName(events).withColumn("state", state).filter(F.col("need").isNotNull() & (F.col("handle").isNull() | (F.col("state") != F.col("need"))))
    bad = bad.select("kind", "handle", "at", "tx_id")
    owners = ops.filter("op = 'EDGE_CREATE'").select("handle", F.col("handle1").alias("owner"), "at").unionByName(snap.edges.rows.select("handle", F.col("src").alias("owner"), F.lit(-1).cast("bigint").alias("at")))
    claims = ops.filter("op in ('EDGE_DELETE', 'EDGE_SET_PROPERTY') and handle1 is not null").select("handle", F.col("handle1").alias("claim"), F.col("at").alias("when"), "tx_id")
    wrong = claims.join(owners, "handle").filter("at < when").groupBy("handle", "when", "tx_id", "claim").agg(F.max_by("owner", "at").alias("owner")).filter("owner != claim")
    return bad.unionByName(wrong.select(F.lit("e").alias("kind"), "handle", F.col("when").alias("at"), "tx_id"))


def _lives(ops: DataFrame, create: str, delete: str, handle: str, alive: DataFrame) -> DataFrame:
    """(handle, was, closed, fresh, since) of created or deleted elements.

    ``closed``: the snapshot's element goes; ``fresh``: a new one stays, whose operations are
    those after ``since``.
    """
    acts = ops.filter(F.col("op").isin(create, delete)).select(F.when(F.col("op") == create, F.col("handle")).otherwise(F.col(handle)).alias("handle"), "at", (F.col("op") == create).alias("made"))
    last = acts.groupBy("handle").agg(F.max_by("made", "at").alias("final"), F.max("at").alias("since"), F.max((~F.col("made")).cast("int")).alias("cut"))
    there = last.join(alive.select("handle", F.lit(1).alias("was")).distinct(), "handle", "left").withColumn("was", F.coalesce("was", F.lit(0)))
    return there.select("handle", "was", ((F.col("was") == 1) & (F.col("cut") == 1)).alias("closed"), F.col("final").alias("fresh"), "since")


def plan(ops: DataFrame, snap: Snapshot, stamp: int) -> Plan:
    """What valid operations change.  The last write to a key wins; an element that is created
    and deleted in one batch leaves no trace; a deleted node takes its out-edges, properties and aliases along."""
    v, none = F.lit(stamp).cast("bigint"), F.lit(None).cast("bigint")
    made = lambda df: df.withColumn("created_v", v).withColumn("deleted_v", none)
    nodes = _lives(ops, "NODE_CREATE", "NODE_DELETE", "handle1", snap.nodes.rows)
    gone = nodes.filter("closed").select("handle")
    edges = _lives(ops, "EDGE_CREATE", "EDGE_DELETE", "handle", snap.edges.rows)
    newest = ops.filter("op = 'EDGE_CREATE'").select("handle", F.col("handle1").alias("src"), F.col("handle2").alias("dst"), "at")
    dead = nodes.filter("not fresh").select(F.col("handle").alias("src"))
    fresh_edges = edges.filter("fresh").join(newest, (edges["handle"] == newest["handle"]) & (edges["since"] == newest["at"])).select(edges["handle"], "src", "dst", "since")
    fresh_edges = fresh_edges.join(dead, "src", "left_anti")
    closed_edges = snap.edges.rows.join(gone.select(F.col("handle").alias("src")), "src", "left_semi").select("handle", "created_v").union(snap.edges.rows.join(edges.filter("closed").select("handle"), "handle", "left_semi").select("handle", "created_v")).distinct()

    def props(op: str, key: str, lives: DataFrame, fresh: DataFrame, table: Elements, closed: DataFrame) -> tuple[DataFrame, DataFrame]:
        sets = ops.filter(F.col("op") == op).select(F.col(key).alias("handle"), "key", "value", "at")
        sets = sets.join(lives.select("handle", "fresh", "since"), "handle", "left").filter(F.col("fresh").isNull() | F.col("fresh") & (F.col("at") > F.col("since")))
        last = sets.groupBy("handle", "key").agg(F.max_by("value", "at").alias("value"), F.max("at").alias("ord"))
        live = table.props
        shut = live.join(last.select("handle", "key"), ["handle", "key"], "left_semi").union(live.join(closed, "handle", "left_semi")).select("handle", "key", "value", "created_v").distinct()
        return made(last.select("handle", "key", "value", "ord")), shut

    node_new, node_shut = props("NODE_SET_PROPERTY", "handle1", nodes, nodes, snap.nodes, gone)
    edge_new, edge_shut = props("EDGE_SET_PROPERTY", "handle", edges, edges, snap.edges, closed_edges.select("handle"))
    names = ops.filter("op = 'ADD_ALIAS'").select(F.col("alias1").alias("alias"), F.col("handle1").alias("handle"), "at").join(nodes.select("handle", "fresh", "since"), "handle", "left")
    names = names.filter(F.col("fresh").isNull() | F.col("fresh") & (F.col("at") > F.col("since"))).select("alias", "handle")
    return Plan(
        {"nodes": made(nodes.filter("fresh").select("handle")), "edges": made(fresh_edges.select("handle", "src", "dst")), "node_props": node_new, "edge_props": edge_new, "aliases": made(names)},
        {
            "nodes": snap.nodes.rows.join(gone, "handle", "left_semi").select("handle", "created_v"),
            "edges": closed_edges,
            "node_props": node_shut,
            "edge_props": edge_shut,
            "aliases": snap.aliases.join(gone, "handle", "left_semi").select("alias", "handle", "created_v"),
        },
    )


class Store:
    """Graphs by commit number, below ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._fs = jvm.org.apache.hadoop.fs
        root = self._fs.Path(f"{self.path}/manifest")
        self._files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._files.mkdirs(root)

    @property
    def head(self) -> int:
        """The last commit; 0 before the first."""
        names = [f.getPath().getName() for f in self._files.listStatus(self._fs.Path(f"{self.path}/manifest"))]
        return max([0, *(int(n.split(".")[0]) for n in names if n.endswith(".json") and not n.startswith(("_", ".")))])

    def _manifest(self, commit: int) -> dict:
        if commit == 0:
            return {"rows": {}, "closed": {}}
        text = self.spark.read.text(f"{self.path}/manifest/{commit:012d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def graph(self, commit: int | None = None) -> Graph:
        """All versions up to a commit (by default the last)."""
        m = self._manifest(self.head if commit is None else commit)

        def table(name: str) -> DataFrame:
            paths = [f"{self.path}/{p}" for p in m["rows"].get(name, [])]
            rows = self.spark.read.schema(TABLES[name]).parquet(*paths) if paths else self.spark.createDataFrame([], TABLES[name])
            shut = [f"{self.path}/{p}" for p in m["closed"].get(name, [])]
            if not shut:
                return rows
            keys = [*KEYS[name], "created_v"]
            closed = self.spark.read.schema(CLOSED).parquet(*shut).select(*keys, "closed_v").groupBy(*keys).agg(F.min("closed_v").alias("closed_v"))
            return rows.join(closed, keys, "left").withColumn("deleted_v", F.coalesce("deleted_v", "closed_v")).select(*[c.split()[0] for c in TABLES[name].split(", ")])

        return Graph(Elements(table("nodes"), table("node_props")), Elements(table("edges"), table("edge_props")), table("aliases"))

    def at(self, commit: int | None = None) -> Snapshot:
        """The graph after a commit, by default the last."""
        c = self.head if commit is None else commit
        return self.graph(c).at(2 * c + 1)

    def _publish(self, commit: int, manifest: dict) -> None:
        hidden = self._fs.Path(f"{self.path}/manifest/_{uuid.uuid4().hex}")
        out = self._files.create(hidden, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        final = self._fs.Path(f"{self.path}/manifest/{commit:012d}.json")
        context = self._fs.FileContext.getFileContext(self._files.getUri())
        none = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(hidden, final, none)
        except Exception as e:
            self._files.delete(hidden, False)
            if self._files.exists(final):
                raise TakenError(f"commit {commit} was taken by another writer") from e
            raise

    def _append(self, commit: int, changes: Plan) -> None:
        m = self._manifest(commit - 1)
        folder = f"data/{commit:012d}-{uuid.uuid4().hex}"
        for kind, tables in (("rows", changes.added), ("closed", changes.closed)):
            for name, df in tables.items():
                if kind == "closed":
                    have = df.columns
                    df = df.select(*[F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in ("handle", "key", "value", "alias")], "created_v", F.lit(2 * commit).cast("bigint").alias("closed_v"))
                at = f"{folder}/{kind}/{name}"
                df.write.parquet(f"{self.path}/{at}")
                if not self.spark.read.schema(df.schema).parquet(f"{self.path}/{at}").isEmpty():
                    m[kind].setdefault(name, []).append(at)
        self._publish(commit, m)

    def commit(self, ops: DataFrame | Iterable[tuple], atomic: bool = True, tries: int = 10) -> tuple[int, set[int]]:
        """Applies transactions in the order (tx_id, seq); returns (commit number, aborted tx ids).

        With ``atomic`` any violation aborts all with :class:`AbortedError`.  Otherwise
        the transactions that violate a rule are left out whole: of those in conflict over an
        element the later ones, until none is left.  A commit that loses the race for its number is checked again
        on the graph that the other writer left, ``tries`` times in all; then :class:`TakenError`.
        """
        if not isinstance(ops, DataFrame):
            ops = self.spark.createDataFrame(list(ops), OPS)
        for left in range(tries - 1, -1, -1):
            try:
                return self._commit(ops, atomic)
            except TakenError:
                if not left:
                    raise
        raise LogicalError("at least one try")

    def _commit(self, ops: DataFrame, atomic: bool) -> tuple[int, set[int]]:
        scratch = Scratch(self.spark, "commit")
        number = self.head + 1
        snap = self.at(number - 1)
        # transaction numbers and sequence numbers become one order without a sort in one task
        if not ops.filter((F.col("seq") < 0) | (F.col("seq") >= 1 << 20)).isEmpty():
            raise LogicalError("a transaction has at most 2 ** 20 operations, numbered from 0")
        ordered = scratch.save(ops.withColumn("at", F.col("tx_id") * (1 << 20) + F.col("seq")), "ops")
        aborted: set[int] = set()
        resolved = scratch.save(_resolve(ordered, snap), "resolved0")
        for i in range(1, ROUNDS + 1):
            bad = scratch.save(violations(resolved, snap), f"bad{i}")
            first = bad.groupBy("kind", "handle").agg(F.min("tx_id").alias("tx_id")).select("tx_id").distinct()
            out = {r["tx_id"] for r in first.collect()}  # conflicting transactions of one batch
            if not out:
                break
            if i == ROUNDS:
                raise AbortedError(f"transactions still in conflict after {ROUNDS} rounds; nothing was committed")
            if atomic:
                raise AbortedError(str(bad.limit(5).collect()))
            aborted |= out
            left = ordered.join(self.spark.createDataFrame([(t,) for t in aborted], "tx_id bigint"), "tx_id", "left_anti")
            resolved = scratch.save(_resolve(left, snap), f"resolved{i}")
        if resolved.isEmpty():
            return number - 1, aborted
        self._append(number, plan(resolved, snap, 2 * number))
        return number, aborted

    def load(self, graph: Graph) -> int:
        """Bulk load: all rows of a graph as one commit."""
        number = self.head + 1
        v, none = F.lit(2 * number).cast("bigint"), F.lit(None).cast("bigint")
        stamp = lambda df: df.withColumn("created_v", v).withColumn("deleted_v", none)
        tables = {"nodes": graph.nodes.rows.select("handle"), "edges": graph.edges.rows.select("handle", "src", "dst"), "node_props": graph.nodes.properties(), "edge_props": graph.edges.properties()}
        if graph.aliases is not None:
            tables["aliases"] = graph.aliases.select("alias", "handle")
        self._append(number, Plan({n: stamp(df) for n, df in tables.items()}, {}))
        return number

    def compact(self, low: int) -> int:
        """Rewrites the log without versions that no reader after commit ``low`` can see."""
        number = self.head + 1
        g = self.graph(number - 1).compact(2 * low)
        tables = {"nodes": g.nodes.rows, "edges": g.edges.rows, "node_props": g.nodes.props, "edge_props": g.edges.props, "aliases": g.aliases}
        folder = f"data/{number:012d}-{uuid.uuid4().hex}"
        m: dict = {"rows": {}, "closed": {}}
        for name, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/rows/{name}")
            m["rows"][name] = [f"{folder}/rows/{name}"]
        self._publish(number, m)
        return number


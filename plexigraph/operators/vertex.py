"""User-written vertex programs, run in supersteps, and a cache of their results."""

from __future__ import annotations

import hashlib
import itertools
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

import pandas as pd
from pyspark.cloudpickle import dumps
from pyspark.sql import DataFrame, functions as F

from ..errors import NotFoundError, UnfinishedError
from ..model import Graph, Snapshot
from ..scratch import Scratch, importable


@dataclass
class Vertex:
    """What a program sees of the vertex it runs at."""

    handle: str
    state: Any
    edges: list[dict]


@dataclass
class Turn:
    """What a program's call leaves behind: the new state, messages and results."""

    state: Any = None
    messages: list[tuple[str, Any]] = field(default_factory=list)
    results: list[Any] = field(default_factory=list)


Compute = Callable[[Vertex, list, Any], Turn]
_ROWS = "handle string, kind string, payload string"


def _step(compute: Compute, params: Any):
    def run(key: tuple, own: pd.DataFrame, mail: pd.DataFrame) -> pd.DataFrame:
        if own.empty or mail.empty:  # no message, or no such (visible) vertex
            return pd.DataFrame({"handle": [], "kind": [], "payload": []}, dtype=object)
        edges = json.loads(own["edges"].iloc[0]) if own["edges"].iloc[0] else []
        state = own["state"].iloc[0]
        vertex = Vertex(key[0], json.loads(state) if state else None, edges)
        messages = [json.loads(m) for m in sorted(mail["payload"])]
        turn = compute(vertex, messages, params)
        rows = [(key[0], "state", json.dumps(turn.state))]
        rows += [(to, "message", json.dumps(m)) for to, m in turn.messages]
        rows += [(key[0], "result", json.dumps(r)) for r in turn.results]
        return pd.DataFrame(rows, columns=["handle", "kind", "payload"])

    return run


def run_program(snap: Snapshot, compute: Compute, starts: list[tuple[str, Any]] | DataFrame, params: Any = None, max_steps: int | None = None, combine: Callable | None = None, traffic: list[DataFrame] | None = None) -> DataFrame:
    """(handle, payload): the results that a program emits, payloads as JSON.

    ``compute(vertex, messages, params)`` runs at each vertex that has messages and returns
    a :class:`Turn`.  State lives per vertex and run.  Messages to a vertex that is not visible
    are dropped.  ``combine``, an aggregate over the column ``payload``, folds the messages to
    one vertex before the shuffle, which a hub needs.  The run ends with the messages; with
    ``max_steps``, a run that still has messages after so many steps raises.
    ``traffic`` collects, per step, (handle, n): the messages to each vertex, as weights for placement.
    """
    importable(snap.spark)
    scratch = Scratch(snap.spark, "program")
    props = snap.edges.properties().groupBy("handle").agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct("key", "value")))).alias("p")) if snap.edges.wide else None
    e = snap.edges.rows.select("handle", "src", "dst")
    e = e.withColumn("p", F.lit(None).cast("map<string,string>")) if props is None else e.join(props, "handle", "left")
    own = e.groupBy("src").agg(F.to_json(F.sort_array(F.collect_list(F.struct(F.col("handle"), F.col("dst"), F.to_json("p").alias("props"))))).alias("edges"))
    vertices = scratch.save(snap.nodes.rows.select("handle").join(own.withColumnRenamed("src", "handle"), "handle", "left"), "vertices")
    states = snap.spark.createDataFrame([], "handle string, state string")
    if isinstance(starts, DataFrame):
        mail = starts.select("handle", "payload")
    else:
        mail = snap.spark.createDataFrame([(h, json.dumps(m)) for h, m in starts], "handle string, payload string")
    results = []
    for step in itertools.count():
        if combine is not None:
            mail = mail.groupBy("handle").agg(combine(F.col("payload")).alias("payload"))
        mail = scratch.save(mail, f"mail{step}")
        if mail.isEmpty():
            break
        if step == max_steps:
            raise UnfinishedError(f"messages are left after {max_steps} steps")
        if traffic is not None:
            traffic.append(mail.groupBy("handle").agg(F.count("*").alias("n")))
        active = vertices.join(mail.select("handle").distinct(), "handle", "left_semi").join(states, "handle", "left")
        turn = scratch.save(active.groupBy("handle").cogroup(mail.groupBy("handle")).applyInPandas(_step(compute, params), _ROWS), f"turn{step}")
        new = turn.filter("kind = 'state'").select("handle", F.col("payload").alias("state"))
        states = scratch.save(states.join(new.select("handle"), "handle", "left_anti").unionByName(new), f"states{step}")
        results.append(turn.filter("kind = 'result'").select("handle", "payload"))
        mail = turn.filter("kind = 'message'").select("handle", "payload")
    out = snap.spark.createDataFrame([], "handle string, payload string")
    for r in results:
        out = out.unionByName(r)
    return out


class Registry:
    """Programs by id: the SHA-256 of their pickled code."""

    def __init__(self) -> None:
        self.programs: dict[str, Compute] = {}

    def register(self, compute: Compute) -> str:
        code = hashlib.sha256(dumps(compute)).hexdigest()
        self.programs[code] = compute
        return code

    def run(self, program: str, snap: Snapshot, starts: list[tuple[str, Any]], params: Any = None, **options: Any) -> DataFrame:
        if program not in self.programs:
            raise NotFoundError(f"program {program}")
        return run_program(snap, self.programs[program], starts, params, **options)


@dataclass
class _Entry:
    version: int
    result: DataFrame
    watch: DataFrame


class ResultCache:
    """Results by (program, arguments), each with the handles that it depends on.

    An entry serves a later version if nothing in its watch set changed in between: one
    semi join of the changes with the watch set.
    """

    def __init__(self, graph: Graph):
        self.graph, self.entries = graph, {}
        self.scratch = Scratch(graph.spark, "cache")
        self.hits = 0

    def get(self, program: str, args: Any, version: int, compute: Callable[[Snapshot], tuple[DataFrame, DataFrame]]) -> DataFrame:
        """``compute(snapshot)`` returns (result, watched handles) and runs only if no entry is valid."""
        key = program, json.dumps(args, sort_keys=True, default=str)
        e = self.entries.get(key)
        if e is not None and e.version <= version:
            touched = self.graph.changes(e.version - 1, version - 1).join(e.watch, "handle", "left_semi")
            if e.version == version or touched.isEmpty():
                self.hits += 1
                return e.result
        result, watch = compute(self.graph.at(version))
        n = len(self.entries)
        entry = _Entry(version, self.scratch.save(result, f"result{n}-{version}"), self.scratch.save(watch.select("handle").distinct(), f"watch{n}-{version}"))
        self.entries[key] = entry
        return entry.result


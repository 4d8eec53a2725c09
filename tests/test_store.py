"""Transactions, versions, the client, files, programs, clocks and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from plexigraph.client import Client
from plexigraph.errors import AbortedError, ActiveTxError, NoActiveTxError, NoAuxIndexError, NotFoundError, WouldLoopError
from plexigraph.functions import clocks, scalars
from plexigraph.model import graph_of
from plexigraph.operators import ordering, paths, vertex
from plexigraph.sources import files
from plexigraph.store import OPS, Store
from plexigraph.streaming import ingest


@pytest.fixture
def client(spark, tmp_path):
    return Client(spark, tmp_path.as_uri() + "/store")


def test_social(client):
    with client.begin_tx() as c:
        c.create_node("u1", ["a1"])
        c.set_node_properties({"type": "user", "age": 25}, "u1")
        c.create_node("u2", ["a2"])
        c.set_node_property("type", "user", "u2")
        c.create_node("post")
        c.set_node_properties({"type": "post", "visibility": "followers"}, "post")
        for e, a, b, t in (("e1", "u1", "u2", "follows"), ("e2", "u2", "u1", "followed_by"), ("e3", "u2", "post", "posted"), ("e4", "post", "u1", "liked_by")):
            c.create_edge(a, b, e)
            c.set_edge_property(e, "type", t)
    node = client.get_node("a1")
    assert node["properties"] == {"type": ["user"], "age": ["25"]} and node["aliases"] == ["a1"]
    assert [e["handle"] for e in node["out_edges"]] == ["e1"]
    t = client.traverse("a2", {"type": "user"}).out_edge({"type": "posted"}).node({"type": "post"}).out_edge({"type": "liked_by"}).node({"type": "user"})
    assert [r["handle"] for r in t.execute().collect()] == ["u1"]
    for act in (lambda: client.create_node("u1"), lambda: client.create_edge("u1", "u2", "e1"), lambda: client.add_alias("a1", "u2"), lambda: client.add_alias("post", "u1")):
        client.begin_tx()
        act()
        with pytest.raises(AbortedError):
            client.end_tx()
    assert client.store.head == 1
    with client.begin_tx() as c:
        c.create_edge(alias1="a1", alias2="a2", handle="e5")
        c.set_node_property("age", 26, alias="a1")
    assert client.get_edge("e5")["end"] == "u2"
    assert client.get_node_properties("u1")["age"] == ["26"] and client.get_node_properties("u1", as_of=1)["age"] == ["25"]
    assert client.edge_count("u1") == 2 and client.edge_count("u1", {"type": "follows"}) == 1
    assert client.get_node_count() == 3 and client.read_n_edges("u1", 1) == ["e1"]
    with pytest.raises(NotFoundError):
        client.get_edge("nothing")


def test_empty_graph_aborts(client):
    for act in (
        lambda c: c.create_edge("a", "b", "e"), lambda c: c.delete_node("a"), lambda c: c.delete_edge("e"),
        lambda c: c.set_node_property("k", "v", "a"), lambda c: c.set_edge_property("e", "k", "v"), lambda c: c.delete_node(alias="x"),
    ):
        client.begin_tx()
        act(client)
        with pytest.raises(AbortedError):
            client.end_tx()
    assert client.store.head == 0


def test_transaction_states(client):
    with pytest.raises(NoActiveTxError):
        client.create_node("x")
    client.begin_tx()
    with pytest.raises(ActiveTxError):
        client.begin_tx()
    client.abort_tx()
    with pytest.raises(NoActiveTxError):
        client.end_tx()
    client._aux = False
    with client.begin_tx(), pytest.raises(NoAuxIndexError):
        client.add_alias("a", "b")


def test_recreate(client):
    with client.begin_tx() as c:
        c.create_node("a")
        c.create_node("b")
        c.create_edge("a", "b", "e1")
        c.create_edge("b", "a", "e2")
    for e in ("e1", "e2"):
        with client.begin_tx() as c:
            c.delete_edge(e, "a" if e == "e1" else "b")
    with client.begin_tx() as c:
        c.create_edge("a", "b", "e1")
        c.create_edge("b", "a", "e2")
    with client.begin_tx() as c:
        c.delete_edge("e1")
        c.delete_edge("e2")
    with client.begin_tx() as c:
        c.delete_node("a")
        c.delete_node("b")
    assert [client.snapshot(v).edges.rows.count() for v in range(1, 7)] == [2, 1, 0, 2, 0, 0]
    assert client.snapshot(6).nodes.rows.count() == 0
    number = client.store.compact(5)
    assert client.snapshot(number).edges.rows.count() == 0 and client.snapshot(number).nodes.rows.count() == 0


def test_a_node_made_again_has_nothing_of_the_old_one(client):
    with client.begin_tx() as c:
        c.create_node("a", ["x"])
        c.create_node("b")
        c.set_node_property("k", "old", "a")
        c.create_edge("a", "b", "e")
    with client.begin_tx() as c:
        c.delete_node("a")
        c.create_node("a")
        c.set_node_property("k", "new", "a")
        c.create_node("gone")
        c.delete_node("gone")
    node = client.get_node("a")
    assert node["properties"] == {"k": ["new"]} and not node["out_edges"] and not node["aliases"]
    assert client.get_node_count() == 2
    with client.begin_tx() as c:
        c.set_node_properties({"k": ["1", "2"]}, "a")
    assert client.read_node_props("a") == [("k", "2")]
    with pytest.raises(AbortedError), client.begin_tx() as c:
        c.create_edge("b", "a", "f")
        c.delete_edge("f", "a")


def test_versions_stay_as_they_were(client):
    """A ring whose edges are replaced at each commit: every version answers as at its time."""
    n = 6
    with client.begin_tx() as c:
        for i in range(n):
            c.create_node(str(i))
    steps = [1, 5, 2]
    for k, m in enumerate(steps):
        with client.begin_tx() as c:
            if k:
                for i in range(n):
                    c.delete_edge(f"{k - 1}-{i}")
            for i in range(n):
                c.create_edge(str(i), str((i + m) % n), f"{k}-{i}")
    for k, m in enumerate(steps):
        path = paths.reach(client.snapshot(k + 2), "0", str(2 * m % n)).first()["path"]
        assert {(int(a) - int(b)) % n for a, b in zip(path, path[1:], strict=False)} == {m}


def test_batches_leave_conflicts_out(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri() + "/s")
    row = lambda tx, seq, op, **k: (tx, seq, op, *(k.get(c) for c in ("handle", "handle1", "handle2", "alias1", "alias2", "key", "value")))
    ops = [row(1, 0, "NODE_CREATE", handle="a"), row(2, 0, "NODE_CREATE", handle="a"), row(2, 1, "NODE_CREATE", handle="b"), row(3, 0, "NODE_SET_PROPERTY", handle1="a", key="k", value="v"), row(4, 0, "NODE_SET_PROPERTY", handle1="b", key="k", value="v")]
    number, out = store.commit(ops, atomic=False)
    assert (number, out) == (1, {2, 4})
    assert [r["handle"] for r in store.at().nodes.rows.collect()] == ["a"]
    with pytest.raises(AbortedError):
        store.commit([row(1, 0, "NODE_CREATE", handle="z"), row(1, 1, "NODE_DELETE", handle1="none")])
    assert store.head == 1
    with pytest.raises(AbortedError):  # a number is taken once
        store._publish(1, {"rows": {}, "closed": {}})


def test_cached_reachability_follows_changes(spark, client):
    """Parallel lines that are cut one by one; a change elsewhere leaves the cache valid."""
    with client.begin_tx() as c:
        for n in ("s", "t", "far", "far2"):
            c.create_node(n)
        for k in range(3):
            c.create_node(f"m{k}")
            c.create_edge("s", f"m{k}", f"a{k}")
            c.create_edge(f"m{k}", "t", f"b{k}")
    for e in ("a0", "a1", None, "a2"):
        with client.begin_tx() as c:
            if e is None:
                c.create_edge("far", "far2", "away")
            else:
                c.delete_edge(e)
    cache = vertex.ResultCache(client.store.graph())

    def compute(snap):
        found = paths.reach(snap, "s", "t")
        watched = snap.edges.rows.filter("handle like 'a%' or handle like 'b%'").select("handle")
        return found, watched

    answers = [cache.get("reach", ["s", "t"], 2 * v + 1, compute).first()["reachable"] for v in range(1, 6)]
    assert answers == [True, True, True, True, False] and cache.hits == 1


def _flood(v, messages, params):
    if v.state:
        return vertex.Turn(v.state)
    return vertex.Turn({"at": min(messages)}, [(e["dst"], min(messages) + 1) for e in v.edges], [min(messages)])


def test_vertex_program(spark):
    g = graph_of(spark, list("abcd"), [("1", "a", "b"), ("2", "b", "c"), ("3", "a", "c"), ("4", "c", "missing")])
    snap = g.at(1)
    registry = vertex.Registry()
    program = registry.register(_flood)
    assert program == registry.register(_flood) and len(program) == 64
    rows = {r["handle"]: json.loads(r["payload"]) for r in registry.run(program, snap, [("a", 0)]).collect()}
    assert rows == {"a": 0, "b": 1, "c": 1}
    traffic = []
    vertex.run_program(snap, _flood, [("a", 0)], traffic=traffic)
    assert [sorted(tuple(r) for r in t.collect()) for t in traffic] == [[("a", 1)], [("b", 1), ("c", 1)], [("c", 1)]]
    with pytest.raises(NotFoundError):
        registry.run("none", snap, [])


def test_clocks(spark):
    rows = [([0, 1, 1], [0, 2, 1], 0), ([0, 2, 1], [0, 1, 1], 1), ([0, 1, 1], [0, 1, 1], 2), ([0, 1, 2], [0, 2, 1], -1), ([1, 0, 0], [0, 9, 9], 1), ([0, 9, 9], [1, 0, 0], 0)]
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, o int")
    out = df.select(clocks.compare(F.col("a"), F.col("b")).alias("c"), "o", clocks.increment(F.col("a"), 1).alias("i"), clocks.merge(F.col("a"), F.col("b")).alias("m"), clocks.new_epoch(F.col("a"), F.lit(1).cast("bigint")).alias("n")).collect()
    assert all(r["c"] == r["o"] for r in out)
    assert out[0]["i"] == [0, 1, 2] and out[3]["m"] == [0, 2, 2] and out[4]["m"] == [1, 0, 0] and out[0]["n"] == [1, 0, 0]
    assert all(ordering.ClockOrder.compare(tuple(a), tuple(b)) == o for a, b, o in rows)
    some = spark.createDataFrame([(1, [0, 1, 2]), (2, [0, 2, 1]), (3, [0, 2, 2]), (4, [1, 0, 0])], "id int, clock array<bigint>")
    assert sorted(r["id"] for r in clocks.least(some).collect()) == [1, 2]
    assert clocks.floor(some).first()["clock"] == [0, 0, 0]


def test_event_order(spark):
    events = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "event_id long")
    edges = spark.createDataFrame([(1, 2), (2, 3)], "src long, dst long")
    pairs = spark.createDataFrame([(1, 3), (3, 1), (1, 4), (1, 9), (1, 1)], "a long, b long")
    found = {(r["a"], r["b"]): r["ord"] for r in ordering.query_order(events, edges, pairs).collect()}
    assert found == {(1, 3): "BEFORE", (3, 1): "AFTER", (1, 4): "CONCURRENT", (1, 9): "NOEXIST", (1, 1): "CONCURRENT"}
    o = ordering.EventOrder()
    a, b, c, d = (o.create_event() for _ in range(4))
    assert [x.value for x in o.assign_order([(a, b, False), (b, c, False)])] == ["BEFORE", "BEFORE"]
    assert [x.value for x in o.query_order([(a, c), (c, a), (a, d), (a, 99)])] == ["BEFORE", "AFTER", "CONCURRENT", "NOEXIST"]
    with pytest.raises(WouldLoopError):
        o.assign_order([(a, d, False), (c, a, False)])
    assert o.query_order([(a, d)])[0].value == "CONCURRENT"
    assert o.assign_order([(c, a, True)])[0].value == "AFTER"
    with pytest.raises(NotFoundError):
        o.acquire_references([a, 99])
    o.acquire_references([b])
    o.release_references([b])
    assert o.query_order([(a, c)])[0].value == "BEFORE"
    o.release_references([b])
    assert o.query_order([(a, b)])[0].value == "NOEXIST" and o.stats["create_event"] == 4
    t = ordering.ClockOrder()
    x, y, z = (0, 1, 2), (0, 2, 1), (0, 3, 3)
    assert t.order(x, y) == 0 and t.order(y, x) == 1 and t.order(x, z) == 0
    assert t.earliest([z, y, x]) == 2 and t.assign([x], z) and not t.assign([z], x) and not t.assign([y], x)
    assert t.cleanup((0, 9, 9)) == 2


def test_batch_order_keeps_no_closure(spark, monkeypatch):
    """Random graphs, with cycles too, against brute force; what is written grows with edges and pairs, not with all that is reached."""
    written, save = [], ordering.Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(ordering.Scratch, "save", counted)
    rng = random.Random(3)
    for kind, n, edges in (("long", 300, [(i, i + 1) for i in range(299)]), ("string", 80, [(rng.randrange(80), rng.randrange(80)) for _ in range(110)]), ("int", 60, [(a, b) for a in range(60) for b in range(a + 1, 60) if rng.random() < 0.05]), ("long", 3, [])):
        ids = (lambda i: f"e{i}") if kind == "string" else int
        after = {i: {b for a, b in edges if a == i} for i in range(n)}
        reached = {}
        for i in range(n):
            todo = [i]
            reached[i] = set()
            while todo:
                new = after[todo.pop()] - reached[i]
                reached[i] |= new
                todo += new
        pairs = {(i, (7 * i + 3) % n) for i in range(n)} | {(rng.randrange(n), rng.randrange(n)) for _ in range(n)}
        frame = lambda rows, names: spark.createDataFrame([tuple(map(ids, r)) for r in rows], ", ".join(f"{c} {kind}" for c in names))
        written.clear()
        got = {(r["a"], r["b"]): r["ord"] for r in ordering.query_order(frame([(i,) for i in range(n)], ["event_id"]), frame(edges, ["src", "dst"]), frame(pairs, ["a", "b"])).collect()}
        assert got == {(ids(a), ids(b)): "CONCURRENT" if a == b else "BEFORE" if b in reached[a] else "AFTER" if a in reached[b] else "CONCURRENT" for a, b in pairs}
        assert max(written) <= 2 * len(pairs) + len(edges)


def test_batch_order_of_large_graphs(spark, monkeypatch):
    """Beyond HELD edges the search is a DataFrame loop, with the same result; few edges and origins at a time change nothing."""
    rng = random.Random(4)
    edges = spark.createDataFrame([(rng.randrange(90), rng.randrange(90)) for _ in range(120)], "src long, dst long")
    events = spark.range(90).select(F.col("id").alias("event_id"))
    pairs = spark.createDataFrame([(a, (a * 7 + 3) % 90) for a in range(90)], "a long, b long")
    first = sorted(map(tuple, ordering.query_order(events, edges, pairs).collect()))
    monkeypatch.setattr(ordering, "AT_ONCE", 3)
    monkeypatch.setattr(ordering, "TABLE", 1)
    assert sorted(map(tuple, ordering.query_order(events, edges, pairs).collect())) == first
    monkeypatch.setattr(ordering, "HELD", 0)
    assert sorted(map(tuple, ordering.query_order(events, edges, pairs).collect())) == first


def test_files(spark, tmp_path):
    (tmp_path / "g.xml").write_text('<graphml><graph>\n<node id="a"><data key="name">x|y</data><data\n key="alias">al</data></node><node id="b"/><node id="a"/>\n<edge id="e" source="a" target="b"><data key="w">3</data></edge><edge source="c" target="b"/></graph></graphml>')
    g = files.load(spark, str(tmp_path / "g.xml"), "graphml", files.LoadOptions("|", "alias")).at(1)
    assert sorted(r["handle"] for r in g.nodes.rows.collect()) == ["a", "b", "c"]
    assert sorted((r["key"], r["value"]) for r in g.nodes.properties().collect()) == [("name", "x"), ("name", "y")]
    assert [tuple(r) for r in g.aliases.select("alias", "handle").collect()] == [("al", "a")]
    assert g.edges.rows.count() == 2 and g.edges.having({"w": "3"}).count() == 1
    (tmp_path / "s.txt").write_text("# c\n1 2\n2\t3\nx 4\n18446744073709551616 1\n\n")
    assert sorted((r["src"], r["dst"]) for r in files.load(spark, str(tmp_path / "s.txt"), "snap").at(1).edges.rows.collect()) == [("1", "2"), ("2", "3")]
    (tmp_path / "p.txt").write_text("1 2 color red size 4\n2 3\n")
    p = files.load(spark, str(tmp_path / "p.txt"), "property_edges").at(1)
    assert p.edges.rows.count() == 2 and sorted((r["key"], r["value"]) for r in p.edges.properties().collect()) == [("color", "red"), ("size", "4")]
    (tmp_path / "t.tsv").write_text("a b\tc\n")
    assert files.load(spark, str(tmp_path / "t.tsv"), "tsv").at(1).nodes.rows.count() == 2
    with pytest.raises(ValueError):
        files.load(spark, "x", "dot")
    full = graph_of(spark, ["a", "b"], [("e", "a", "b")], [("a", "k", "v")])
    files.write_graph(full, str(tmp_path / "pq"), buckets=4)
    back = files.load(spark, str(tmp_path / "pq"), "parquet").at(1)
    assert back.edges.rows.count() == 1 and back.nodes.having({"k": "v"}).count() == 1
    pairs = spark.createDataFrame([("b", "a"), ("b", "a"), ("c", "b")], "src string, dst string")
    assert sorted(tuple(r) for r in files.clean_edges(pairs).collect()) == [(1, 0), (2, 1)]
    assert files.coloured_edges(files.clean_edges(pairs)).count() == 2


def test_scalars(spark):
    df = spark.createDataFrame([("18446744073709551615", " 12x", "1.5 ", "a,b,"), ("18446744073709551616", "x", "y", "a"), ("-1", "-3", "", ",")], "u string, i string, d string, s string")
    rows = df.select(scalars.parse_uint64(F.col("u")).cast("string").alias("u"), scalars.parse_int(F.col("i")).alias("i"), scalars.parse_double(F.col("d")).alias("d"), scalars.split_values(F.col("s"), ",").alias("s")).collect()
    assert [r["u"] for r in rows] == ["18446744073709551615", None, None]
    assert [r["i"] for r in rows] == [12, None, -3] and [r["d"] for r in rows] == [1.5, None, None]
    assert [r["s"] for r in rows] == [["a", "b"], ["a"], [""]]


def test_streaming_ingest(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri() + "/s")
    none = (None,) * 5
    for i, rows in enumerate(([(1, 0, "NODE_CREATE", "a", None, *none)], [(2, 0, "NODE_CREATE", "b", None, *none), (3, 0, "NODE_CREATE", "a", None, *none)])):
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ops = spark.readStream.schema(OPS).parquet(str(tmp_path / "in"))
        ingest.ingest(ops, store, str(tmp_path / "ck")).awaitTermination()
        assert store.at().nodes.rows.count() == i + 1
    assert store.head == 2
    stamped = ops.withColumn("ts", F.current_timestamp())
    assert ingest.deduplicated(stamped, "ts").isStreaming and ingest.windowed_writes(stamped, "ts").columns == ["start", "op", "n"]


def test_batch_and_bulk_load(spark, tmp_path):
    store = Store(spark, tmp_path.as_uri() + "/s")
    store.load(graph_of(spark, ["a", "b"], [("e", "a", "b")], [("a", "k", "1"), ("a", "k", "2")], [("e", "w", "3")], [("al", "a")]))
    assert store.at().nodes.having({"k": ["1", "2"]}).count() == 1
    assert store.at().aliases.count() == 1 and store.at(0).nodes.rows.count() == 0


def test_client_programs(spark, tmp_path):
    """Every program through the client, on one bulk-loaded graph."""
    client = Client(spark, tmp_path.as_uri() + "/s")
    nodes = ["a", "b", "c", "d", "B", "t0"]
    edges = [("ab", "a", "b"), ("bc", "b", "c"), ("ac", "a", "c"), ("cd", "c", "d"), ("BLOCK_TX_0", "B", "t0"), ("TXOUT_x", "t0", "a"), ("CTX_x", "t0", "b"), ("the,end,0", "a", "d")]
    props = [("ab", "w", "1"), ("bc", "w", "1"), ("ac", "w", "5"), ("cd", "w", "2"), ("the,end,0", "locs", "(7, 1999, [1])"), ("ab", "c", "0.9"), ("bc", "c", "0.9"), ("ac", "c", "0.2"), ("cd", "c", "0.9")]
    client.store.load(graph_of(spark, nodes, edges, [("d", "name", "last"), ("c", "name", "third")], props, [("first", "a")]))
    assert client.reach("a", "d")["path"] == ["d", "a"] and client.pathless_reach("a", "d")
    assert client.n_hop_reach("a", "c", 0)["reachable"] is False and client.reach("b", "d")["hops"] == 2
    assert client.shortest_path("a", "d", "w") == {"cost": 4, "path": ["a", "b", "c", "d"]}
    assert client.widest_path("a", "c", "w")["cost"] == 5
    assert client.clustering("a") == pytest.approx(2 / 6) and client.clustering("d") == 0
    assert client.two_neighborhood("first", "name") == [("c", "third"), ("d", "last")]
    dag = client.discover_paths("a", "d", path_len=3, edge_preds=[("c", "0.9")])
    found = client.enumerate_paths(dag, "a", "d", 3)
    assert [r["path"] for r in found.collect()] == [["a", "b", "c", "d"]]
    assert len(client.enumerate_path_vertices(found).first()["pairs"]) == 3
    best = client.cause_and_effect("a", "d", "c", max_results=1).first()
    assert best["path"] == ["a", "b", "c", "d"] and best["confidence"] == pytest.approx(0.729)
    assert [r["doc"] for r in client.n_gram_path(["the", "end"]).collect()] == [7]
    assert client.get_btc_block("B") == {"handle": "B", "txs": ["t0"], "num_nodes_read": 3}
    assert {r["consumed"] for r in client.get_btc_tx("t0").collect()} == {"b", None}
    assert client.get_btc_addr("a").count() == 3
    assert client.traverse_props("a", [None, None], [{"w": "1"}]).first()["handle"] == "b"
    assert sorted(r["handle"] for r in client.get_edges("a", nbrs=["b", "c"]).collect()) == ["ab", "ac"]
    assert client.read_edges_props("a", ["w"]).count() == 2 and client.get_node_edges("d") == []
    assert client.get_node_aliases("a") == ["first"]
    program = client.register_node_prog(_flood)
    assert client.run_node_prog(program, [("a", 0)]).count() == 4
    assert client.single_stream_migration(2).count() == 6 and client.aux_index


def test_lost_race_is_tried_again(spark, tmp_path):
    """A writer that loses its number commits after the other one; its rules are checked on what the other left."""
    path = f"file://{tmp_path}/race"
    ours, theirs = Store(spark, path), Store(spark, path)
    node = lambda h: [(1, 0, "NODE_CREATE", h, None, None, None, None, None, None)]
    ours.commit(node("first"))
    append, lost = ours._append, []

    def late(number, changes):
        if not lost:
            lost.append(theirs.commit(node("theirs"))[0])
        append(number, changes)

    ours._append = late
    assert ours.commit(node("ours"))[0] == 3 and lost == [2]
    assert {r[0] for r in theirs.at().nodes.rows.select("handle").collect()} == {"first", "theirs", "ours"}
    lost.clear()
    with pytest.raises(AbortedError):
        ours.commit(node("theirs"))

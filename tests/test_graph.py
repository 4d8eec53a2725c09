"""Hand-computed results on small graphs."""

import random
from collections import deque

import pytest
from pyspark.sql import functions as F

from plexigraph.errors import LogicalError, NotFoundError
from plexigraph.functions.predicates import Pred, Relation
from plexigraph.model import Elements, Graph, frame, graph_of
from plexigraph.operators import access, local, network, paths, phrases, placement, star, vertex
from plexigraph.operators.traverse import Traversal, traverse_props

NOW = 10


def handles(df, col="handle"):
    return sorted(r[col] for r in df.collect())


def start(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "handle string")


@pytest.fixture(scope="module")
def social(spark):
    return graph_of(
        spark,
        ["u1", "u2", "post"],
        [("e1", "u1", "u2"), ("e2", "u2", "u1"), ("e3", "u2", "post"), ("e4", "post", "u1")],
        [("u1", "type", "user"), ("u1", "age", "25"), ("u2", "type", "user"), ("post", "type", "post"), ("post", "visibility", "followers")],
        [("e1", "type", "follows"), ("e2", "type", "followed_by"), ("e3", "type", "posted"), ("e4", "type", "liked_by")],
        [("a1", "u1"), ("a2", "u2")],
    ).at(NOW)


def test_traverse(social):
    for who in ("u2", "a2"):
        t = Traversal(social, who, {"type": "user"}).out_edge({"type": "posted"}).node({"type": "post"}).out_edge({"type": "liked_by"}).node({"type": "user"})
        assert handles(t.execute()) == ["u1"]
        assert handles(t.collect_nodes()) == ["post", "u1", "u2"]
        assert handles(t.collect()) == ["e3", "e4", "post", "u1", "u2"]


def test_traverse_visits_once_and_ends_on_edges(social):
    back = Traversal(social, "u1").out_edge({"type": "follows"}).node().out_edge({"type": "followed_by"}).node()
    assert handles(back.execute()) == []
    assert handles(Traversal(social, "u2").out_edge().execute()) == ["e2", "e3"]
    assert handles(traverse_props(social, "u2", [{"type": "user"}], [{"type": "posted"}])) == ["e3"]
    with pytest.raises(LogicalError):
        traverse_props(social, "u2", [None], [None, None])
    with pytest.raises(NotFoundError):
        Traversal(social, "nobody")
    assert handles(Traversal(social, "u2").out_edge().node(aliases=["a1"]).execute()) == ["u1"]


def test_access(social, spark):
    row = access.get_nodes(social, start(spark, "u1")).first().asDict(recursive=True)
    assert row["properties"] == {"type": ["user"], "age": ["25"]}
    assert row["out_edges"] == [{"handle": "e1", "dst": "u2"}] and row["aliases"] == ["a1"]
    assert "properties" not in access.get_nodes(social, props=False).columns
    assert access.get_edge(social, "e3") == ("e3", "u2", "post")
    with pytest.raises(NotFoundError):
        access.get_edge(social, "none")
    assert handles(access.get_edges(social, ["u2"], ["u1", "post"], ["e2", "zzz"])) == ["e2"]
    assert handles(access.get_edges(social, ["u2"], props={"type": "posted"})) == ["e3"]
    assert {r["src"]: r["n"] for r in access.edge_count(social).collect()} == {"u1": 1, "u2": 2, "post": 1}
    assert handles(access.read_n_edges(social, 1)) == ["e1", "e2", "e4"]
    assert len(access.read_n_edges(social, 0).collect()) == 4
    assert {r["handle"]: r["exists"] for r in access.edge_exists(social, start(spark, "e1", "x")).collect()} == {"e1": True, "x": False}
    assert {r["handle"]: r["value"] for r in social.nodes.value("age").collect()} == {"u1": "25", "u2": "", "post": ""}
    assert sum(r["n"] for r in access.node_count(social, 4).collect()) == 3
    assert access.edge_total(social).first()["n"] == 4
    assert handles(access.edges_of(social)) == ["e1", "e2", "e3", "e4"]


def test_views_and_versions(social, spark):
    social.views("g")
    rows = spark.sql("SELECT e.handle FROM g_edges e JOIN g_edge_props p ON p.handle = e.handle AND p.value = 'posted'").collect()
    assert [r[0] for r in rows] == ["e3"]
    g = Graph(Elements(frame(spark, "nodes", [("a", 2, 6), ("a", 8, None), ("b", 4, None)])), Elements(frame(spark, "edges", [])), None)
    asked = spark.createDataFrame([(h, v) for h in "ab" for v in (1, 3, 6, 7, 9)], "handle string, version long")
    assert sorted(tuple(r) for r in access.versions_at(g, asked).collect()) == [("a", 3, 2), ("a", 9, 8), ("b", 6, 4), ("b", 7, 4), ("b", 9, 4)]
    assert g.compact(7).nodes.rows.count() == 2


def test_predicates(spark):
    vals = ["", "10", "9", "abc", "b", "é", "z"]
    g = graph_of(spark, [f"n{i}" for i in range(len(vals))] + ["none"], [], [(f"n{i}", "k", v) for i, v in enumerate(vals)]).at(NOW)
    tests = {
        Relation.EQUALS: lambda a, b: a == b, Relation.LESS: lambda a, b: a < b, Relation.GREATER: lambda a, b: a > b, Relation.LESS_EQUAL: lambda a, b: a <= b,
        Relation.GREATER_EQUAL: lambda a, b: a >= b, Relation.STARTS_WITH: str.startswith, Relation.ENDS_WITH: str.endswith, Relation.CONTAINS: lambda a, b: b in a,
    }
    for rel, f in tests.items():
        for v in ("", "9", "b", "z"):
            assert handles(g.nodes.having([Pred("k", rel, v)])) == [f"n{i}" for i, x in enumerate(vals) if f(x, v)], (rel, v)
    with pytest.raises(ValueError):
        Pred("k", "similar", "x")


def test_different_values_may_satisfy_two_predicates(spark):
    g = graph_of(spark, ["a", "b"], [], [("a", "k", "a"), ("a", "k", "z"), ("b", "k", "z")]).at(NOW)
    assert handles(g.nodes.having([Pred("k", Relation.LESS, "c"), Pred("k", Relation.GREATER, "m")])) == ["a"]
    assert handles(g.nodes.having({"k": ["a", "z"]})) == ["a"]
    assert access.get_nodes(g, edges=False, aliases=False).filter("handle = 'a'").first()["properties"] == {"k": ["a", "z"]}


def line(spark, n, both=False):
    edges = [(f"e{i}", str(i), str(i + 1)) for i in range(n - 1)]
    if both:
        edges += [(f"r{i}", str(i + 1), str(i)) for i in range(n - 1)]
    return graph_of(spark, [str(i) for i in range(n)], edges, [], [(f"e{i}", "color", "blue") for i in range(0, n - 1, 2)]).at(NOW)


def test_line_reachability(spark):
    g = line(spark, 12)
    assert len(handles(paths.reaches(g, "11"))) == 12
    assert handles(paths.reaches(g, "0")) == ["0"]
    row = paths.reach(g, "0", "3").first()
    assert (row["reachable"], row["hops"], row["path"]) == (True, 3, ["3", "2", "1", "0"])
    assert tuple(paths.reach(g, "3", "0").first()) == (False, None, None)
    assert tuple(paths.reach(g, "3", "3").first()) == (True, 0, ["3"])
    assert not paths.pathless_reach(g, "0", "11", {"color": "blue"})
    assert paths.pathless_reach(g, "0", "1", {"color": "blue"})


def test_hop_bound(spark):
    g = line(spark, 7, both=True)
    for bound in range(4):
        for dst in (0, 2, 4, 6):
            assert paths.reach(g, "3", str(dst), max_hops=bound).first()["reachable"] == (bound >= abs(dst - 3))


def test_weighted_paths(spark):
    rows = [(0, 1, 6), (0, 2, 5), (1, 3, 6), (1, 4, 7), (2, 4, 6), (3, 2, 6), (3, 5, 8), (4, 5, 6)]
    g = graph_of(spark, [str(i) for i in range(6)], [(f"e{i}", str(a), str(b)) for i, (a, b, _) in enumerate(rows)], [], [(f"e{i}", "weight", str(w)) for i, (_, _, w) in enumerate(rows)] + [("e0", "other", "x")]).at(NOW)
    assert tuple(paths.weighted_path(g, "0", "5", "weight").first()) == (17, ["0", "2", "4", "5"])
    assert paths.weighted_path(g, "0", "5", "weight", widest=True).first()["cost"] == 6
    assert tuple(paths.weighted_path(g, "5", "0", "weight").first()) == (0, [])
    assert tuple(paths.weighted_path(g, "0", "5", "absent").first()) == (0, [])


def test_deleted_nodes_are_not_on_paths(spark):
    """A weighted tree of height 3 into a sink; the left leaf goes, its in-edge stays."""
    edges = [(f"t{c}", str(c // 2), str(c), c) for c in range(2, 8)] + [(f"s{c}", str(c), "sink", 0) for c in range(4, 8)]
    nodes = [(str(i), 0, 5 if i == 4 else None) for i in range(1, 8)] + [("sink", 0, None)]
    g = Graph(Elements(frame(spark, "nodes", nodes)), Elements(frame(spark, "edges", [e[:3] for e in edges]), frame(spark, "edge_props", [(e[0], "weight", str(e[3]), 0) for e in edges])), None)
    assert paths.weighted_path(g.at(3), "1", "sink", "weight").first()["cost"] == 6
    assert paths.weighted_path(g.at(9), "1", "sink", "weight").first()["cost"] == 7


LAYERS = "src-1a* src-1b src-3 1a-2a* 1a-2b 1a-2c 1b-2d 1b-2e 2c-3 2d-3 3-1a 2a-dst* 2b-dst 2e-dst 3-dst".split()


@pytest.fixture(scope="module")
def layers(spark):
    pairs = [e.rstrip("*").split("-") for e in LAYERS]
    red = [(e.rstrip("*"), "color", "red") for e in LAYERS if e.endswith("*")]
    return graph_of(spark, sorted({x for p in pairs for x in p}), [("-".join(p), *p) for p in pairs], [], red).at(NOW)


def test_discover_and_enumerate(layers):
    dag = paths.discover_paths(layers, "src", "dst")
    found = paths.enumerate_paths(dag, "src", "dst", 10)
    by = {}
    for r in found.collect():
        by[len(r["edges"])] = by.get(len(r["edges"]), 0) + 1
    assert by == {2: 1, 3: 3, 4: 4, 6: 2}
    assert handles(paths.discover_paths(layers, "src", "dst", 2)) == ["3-dst", "src-3"]
    red = paths.enumerate_paths(paths.discover_paths(layers, "src", "dst", edge_preds={"color": "red"}), "src", "dst", 10)
    assert [r["path"] for r in red.collect()] == [["src", "1a", "2a", "dst"]]
    vertices = paths.path_vertices(red).first()["pairs"]
    assert [(p["start"], p["end"]) for p in vertices] == [("src", "1a"), ("1a", "2a"), ("2a", "dst")]
    exact = paths.discover_paths(layers, "src", None, 2)
    assert "src-3" in handles(exact) and "2a-dst" not in handles(exact)
    narrow = paths.discover_paths(layers, "src", "dst", branching=1, branching_property="none")
    assert {r["src"] for r in narrow.collect()} <= {"src", "1a", "2a", "3"}


def test_confidence(spark):
    g = graph_of(spark, list("abcd"), [("ab", "a", "b"), ("bd", "b", "d"), ("ac", "a", "c"), ("cd", "c", "d"), ("ad", "a", "d")], [], [("ab", "c", "0.9"), ("bd", "c", "0.5"), ("ac", "c", "0.05"), ("cd", "c", "1.0"), ("ad", "c", "0.01")]).at(NOW)
    rows = {tuple(r["path"]): round(r["confidence"], 6) for r in paths.cause_and_effect(g, "a", "d", "c").collect()}
    assert rows == {("a", "b", "d"): 0.45, ("a", "d"): 0.01}
    assert [tuple(r["path"]) for r in paths.cause_and_effect(g, "a", "d", "c", max_results=1).collect()] == [("a", "b", "d")]


def test_clustering_star(spark):
    n = 12
    star_ = [(f"s{i}", "c", str(i)) for i in range(n)]
    back = [(f"b{i}", str(i), "c") for i in range(n)]
    ring = [(f"r{i}", str(i), str((i + 1) % n)) for i in range(n)]
    value = lambda edges: local.clustering(graph_of(spark, ["c", *map(str, range(n))], edges).at(NOW)).filter("handle = 'c'").first()["coefficient"]
    assert value(star_) == 0 and value(star_ + back) == 0
    for j in (1, 5, n):
        assert value(star_ + back + ring[:j]) == pytest.approx(j / (n * (n - 1)))
    assert value([("x", "c", "1"), ("y", "c", "1"), ("z", "1", "1")]) == 0


def test_clustering_of_random_graphs(spark):
    rng = random.Random(7)
    rows = [(f"e{i}", str(rng.randrange(14)), str(rng.randrange(14))) for i in range(90)]
    g = graph_of(spark, [str(i) for i in range(14)], rows).at(NOW)
    plain = [(a, b) for _, a, b in rows if a != b]
    for r in local.clustering(g).collect():
        c = r["handle"]
        near = {b for a, b in plain if a == c}
        closed = sum(1 for a, x in plain if a == c for y, z in plain if y == x and z in near and z != c)
        assert (r["closed"], r["k"]) == (closed, len(near)), c


def test_two_hops(spark):
    e = [("c", "0"), ("c", "1"), ("c", "2"), ("2", "3"), ("0", "4"), ("0", "1"), ("1", "2")]
    g = graph_of(spark, ["c", "0", "1", "2", "3", "4"], [(f"{a}{b}", a, b) for a, b in e], [("c", "name", "BAD1"), ("0", "name", "BAD2"), ("2", "name", "Scarlet"), ("3", "name", "Greg"), ("4", "name", "Ayush")]).at(NOW)
    assert sorted(r["value"] for r in local.two_neighborhood(g, "name", start(spark, "c")).collect()) == ["Ayush", "Greg", "Scarlet"]
    assert local.two_neighborhood(g, "nope", start(spark, "c")).count() == 0


def test_network(spark):
    f = [("sa", "s", "a", "0.5", "0"), ("sb", "s", "b", "-1.0", "1"), ("at", "a", "t", "2.0", "0"), ("bt", "b", "t", "1.0", "1")]
    b = [("as", "a", "s"), ("bs", "b", "s"), ("ta", "t", "a"), ("tb", "t", "b")]
    props = [(e[0], "dir", "f") for e in f] + [(e[0], "dir", "b") for e in b] + [(e[0], "weight", e[3]) for e in f] + [(e[0], "order", e[4]) for e in f]
    g = graph_of(spark, list("sabt"), [e[:3] for e in f] + b, [], props).at(NOW)
    assert network.infer(g, "s", "t", [2, 3]) == pytest.approx([1.4621171572600098, 0.04742587317756678])
    assert network.infer(g, "s", "t", [2, 3], "relu") == pytest.approx([2.0, 0.0])
    assert network.infer(g, "s", "t", [2, 3], "no such") == pytest.approx([1.4621171572600098, 0.04742587317756678])
    with pytest.raises(NotFoundError):
        network.infer(g, "t", "s", [1])


def test_phrases(spark):
    g = graph_of(spark, ["the", "quick", "fox"], [("the,quick,0", "the", "quick"), ("quick,fox,0", "quick", "fox")], [], [("the,quick,0", "locs", "(1, 1999, [4, 9]); (2, 2001, [7])"), ("quick,fox,0", "locs", "(1, 1999, [5]); (2, 2001, [9])")]).at(NOW)
    found = phrases.occurrences(g)
    get = lambda *w: {(r["doc"], r["date"]) for r in phrases.phrase(found, list(w)).collect()}
    assert get("the", "quick") == {(1, "1999"), (2, "2001")} == get("the")
    assert get("the", "quick", "fox") == {(1, "1999")}
    assert get("the", "slow") == set()
    docs = spark.createDataFrame([(1, "a b a b a"), (2, "b a"), (3, None), (4, "")], "doc_id long, text string")
    pairs = phrases.word_pairs(docs)
    assert [r["doc"] for r in phrases.phrase(pairs, ["a", "b", "a", "b", "a"]).collect()] == [1]
    assert phrases.phrase(pairs, ["a", "a"]).count() == 0


def test_ledger(spark):
    g = graph_of(spark, ["B", "E", "t0", "t1", "addr1"], [("BLOCK_TX_0", "B", "t0"), ("BLOCK_TX_1", "B", "t1"), ("TXOUT_x", "t0", "addr1"), ("CTX_x", "t0", "t1"), ("back", "addr1", "t0")]).at(NOW)
    blocks = {r["handle"]: (r["txs"], r["num_nodes_read"]) for r in star.get_block(g, start(spark, "B", "E")).collect()}
    assert blocks == {"B": (["t0", "t1"], 4), "E": ([], 1)}
    assert {r["handle"]: r["consumed"] for r in star.get_tx(g, start(spark, "t0")).collect()} == {"TXOUT_x": "t1", "CTX_x": None}
    assert [tuple(r) for r in star.get_address(g, start(spark, "addr1")).collect()] == [("addr1", "t0")]


def test_placement(spark):
    """Two cliques of 10 joined by one edge: greedy placement cuts less than hashing."""
    e = [(f"{a}-{b}", f"{s}{a}", f"{s}{b}") for s in "xy" for a in range(10) for b in range(10) if a != b]
    e = [(f"{i}", a, b) for i, (_, a, b) in enumerate(e)] + [("tie", "x0", "y0")]
    g = graph_of(spark, [f"{s}{i}" for s in "xy" for i in range(10)], e).at(NOW)
    for options in ({}, {"clustered": True}):
        placed = placement.greedy(g, 2, **options)
        assert placed.count() == 20
        assert placement.edge_cut(g, placed).first()["cut"] < placement.edge_cut(g, placement.by_hash(g, 2)).first()["cut"]
    sizes = sorted(r["n"] for r in placement.round_robin(g, 3).groupBy("shard").agg(F.count("*").alias("n")).collect())
    assert sizes == [6, 7, 7]


def test_shortest_paths_of_random_graphs(spark):
    rng = random.Random(3)
    rows = [(f"e{i}", str(rng.randrange(25)), str(rng.randrange(25))) for i in range(70)]
    g = graph_of(spark, [str(i) for i in range(25)], rows).at(NOW)
    near, queue = {"0": 0}, deque(["0"])
    while queue:
        x = queue.popleft()
        for _, a, b in rows:
            if a == x and b not in near:
                near[b] = near[a] + 1
                queue.append(b)
    assert {r["handle"]: r["hops"] for r in paths.reach_set(g, start(spark, "0")).collect()} == near


def test_bounds_raise(spark):
    """A loop that reaches the bound its caller set says so; by default there is none."""
    from plexigraph.errors import LogicalError, UnfinishedError
    from plexigraph.store import OPS, Store

    line = graph_of(spark, [str(i) for i in range(5)], [(f"e{i}", str(i), str(i + 1)) for i in range(4)]).at(1)
    walk = lambda v, messages, params: vertex.Turn(None, [(e["dst"], 1) for e in v.edges], [1])
    with pytest.raises(UnfinishedError):
        vertex.run_program(line, walk, [("0", 1)], max_steps=2)
    assert vertex.run_program(line, walk, [("0", 1)], max_steps=5).count() == 5
    long = graph_of(spark, [str(i) for i in range(14)], [(f"e{i}", str(i), str(i + 1)) for i in range(13)], (), [(f"e{i}", "c", "0.99") for i in range(13)]).at(1)
    assert paths.cause_and_effect(long, "0", "13", "c").count() == 1
    store = Store(spark, f"{spark.conf.get('spark.checkpoint.dir')}/bounds")
    with pytest.raises(LogicalError):
        store.commit(spark.createDataFrame([(1, 1 << 20, "NODE_CREATE", "a", *[None] * 6)], OPS))

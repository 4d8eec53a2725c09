"""More of the catalogue: point reads, client writes, clock arithmetic, inference, loaders and text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..client import Client
from ..errors import AbortedError
from ..functions import clocks, scalars
from ..model import Elements, Graph, frame
from ..operators import access, network, paths, phrases
from ..scratch import shared_dir
from ..sources import binding as b, files
from .catalog import CLOCK, DAG_SQL, USERS_SQL, WHOLE_LEN, query


def _sales(spark: SparkSession, sf_dir: str):
    return b.sales_graph(spark, sf_dir).at(b.NOW)


def _users(spark: SparkSession, sf_dir: str):
    return b.user_graph(spark, sf_dir).at(b.NOW)


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- point reads -------------------------------------------------------------------


@query("""SELECT c_custkey AS custkey, c_name AS name, c_mktsegment AS segment, 5 AS n_keys, list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL) AS orders, c_name AS alias
FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY ALL""")
def node_get(spark, sf_dir):
    """Nodes whole: properties, out-edges and aliases."""
    snap = _sales(spark, sf_dir)
    rows = access.get_nodes(snap, snap.nodes.having({"type": "customer", "mktsegment": "BUILDING"}).select("handle"))
    value = lambda key: F.element_at(F.col("properties")[key], 1)
    orders = F.sort_array(F.transform("out_edges", lambda e: F.substring(e["dst"], 2, 20).cast("bigint")))
    return rows.select(b.key_of("handle").alias("custkey"), value("name").alias("name"), value("mktsegment").alias("segment"), F.size("properties").alias("n_keys"), orders.alias("orders"), F.element_at("aliases", 1).alias("alias"))


@query("""SELECT o_orderkey AS orderkey, o_custkey AS custkey, 'type=placed' AS properties FROM orders WHERE o_custkey IN (1, 2, 4, 5) AND o_orderkey % 2 = 0""")
def edge_client_form(spark, sf_dir):
    """Edges of some nodes to some neighbours, in client form."""
    snap = _sales(spark, sf_dir)
    even = b.table(spark, sf_dir, "orders").filter("o_custkey in (1, 2, 4, 5) and o_orderkey % 2 = 0")
    nbrs = [r[0] for r in even.select(b.handle("O", "o_orderkey")).collect()]  # the neighbour list of a point read
    rows = access.get_edges(snap, src=["C1", "C2", "C4", "C5"], nbrs=nbrs, props={"type": "placed"})
    form = F.array_join(F.transform("properties", lambda p: F.concat(p["key"], F.lit("="), p["value"])), ";")
    return access.edges_of(snap, rows).select(b.key_of("end").alias("orderkey"), b.key_of("start").alias("custkey"), form.alias("properties"))


@query("""SELECT 'p' || o_orderkey AS handle, 'C' || o_custkey AS src, 'O' || o_orderkey AS dst FROM orders WHERE o_orderkey = 1""")
def edge_get_one(spark, sf_dir):
    return spark.createDataFrame([access.get_edge(_sales(spark, sf_dir), "p1")], "handle string, src string, dst string")


@query("""SELECT c_custkey AS custkey FROM customer WHERE c_name = 'Customer#000000003'""")
def nodes_with_alias(spark, sf_dir):
    snap = _sales(spark, sf_dir)
    return access.has_aliases(snap, snap.nodes.rows, ["Customer#000000003"]).select(b.key_of("handle").alias("custkey"))


@query(f"""WITH {USERS_SQL} SELECT src, least(count(*), 3) AS n, least(count(*), 3) AS n_real FROM u GROUP BY 1""")
def random_neighbors(spark, sf_dir):
    """How many random edges each node got, and how many of them exist."""
    snap = _users(spark, sf_dir)
    got = access.random_neighbors(snap, 3)
    real = snap.edges.rows.select("handle", F.lit(1).alias("there"))
    return got.join(real, "handle", "left").groupBy(b.key_of("src").alias("src")).agg(F.countDistinct("dst").alias("n"), F.count("there").alias("n_real"))


# -- paths, whole ----------------------------------------------------------------------


def _steps(path: Column) -> Column:
    """array<struct<src, dst>> of a path's nodes in order."""
    return F.transform(F.slice(path, 2, 1 << 30), lambda x, i: F.struct(F.get(path, i).alias("src"), x.alias("dst")))


_WEIGHTS_SQL = f"""WITH RECURSIVE {USERS_SQL}, e AS (SELECT src, dst, 1 + (src * 7 + dst * 13) % 20 AS w FROM u)"""


@query(f"""{_WEIGHTS_SQL}, r(node, cost) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, cost + w FROM r JOIN e ON node = src WHERE cost + w <= 40)
SELECT min(cost) AS cost, min(cost) AS along, 'U0' AS first, 'U5' AS last FROM r WHERE node = 5""")
def shortest_path_nodes(spark, sf_dir):
    """The cheapest path, and what its own edges cost."""
    return _along(_users(spark, sf_dir), False, F.sum)


@query(f"""{_WEIGHTS_SQL}, r(node, cost) AS (SELECT CAST(0 AS BIGINT), CAST(21 AS BIGINT) UNION SELECT dst, least(cost, w) FROM r JOIN e ON node = src)
SELECT max(cost) AS cost, max(cost) AS along, 'U0' AS first, 'U5' AS last FROM r WHERE node = 5""")
def widest_path_nodes(spark, sf_dir):
    return _along(_users(spark, sf_dir), True, F.min)


def _along(snap, widest: bool, combine) -> DataFrame:
    found = paths.weighted_path(snap, "U0", "U5", "weight", widest)
    steps = found.select("cost", F.get("path", F.lit(0)).alias("first"), F.element_at("path", -1).alias("last"), F.explode(_steps(F.col("path"))).alias("s")).select("cost", "first", "last", "s.*")
    there = steps.join(paths.weights(snap, "weight"), ["src", "dst"], "left")
    # a step that is no edge has no weight, and leaves no sum
    along = F.when(F.count("*") == F.count("w"), combine("w"))
    return there.groupBy("cost", "first", "last").agg(along.alias("along"))


@query(f"""WITH RECURSIVE {USERS_SQL}, r(node, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, hops + 1 FROM r JOIN u ON node = src WHERE hops < 12)
SELECT min(hops) AS hops, CAST(min(hops) AS BIGINT) AS n_edges, 'U0' AS first, 'U5' AS last FROM r WHERE node = 5""")
def reach_path_nodes(spark, sf_dir):
    """The path of a reachability query, and how many of its steps are edges."""
    snap = _users(spark, sf_dir)
    found = paths.reach(snap, "U0", "U5").select("hops", F.reverse("path").alias("path"))
    steps = found.select("hops", F.get("path", F.lit(0)).alias("first"), F.element_at("path", -1).alias("last"), F.explode(_steps(F.col("path"))).alias("s")).select("hops", "first", "last", "s.*")
    return steps.join(snap.edges.rows.select("src", "dst"), ["src", "dst"]).groupBy("hops", "first", "last").agg(F.count("*").alias("n_edges"))


@query(f"""WITH RECURSIVE {USERS_SQL}, r(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM r JOIN u ON node = src)
SELECT to_node, EXISTS (SELECT 1 FROM r WHERE node = to_node) AS reachable FROM (VALUES (5), (9), (-1)) AS t(to_node)""")
def pathless_reach(spark, sf_dir):
    snap = _users(spark, sf_dir)
    return spark.createDataFrame([(n, paths.pathless_reach(snap, "U0", f"U{n}")) for n in (5, 9, -1)], "to_node int, reachable boolean")


@query(f"""{DAG_SQL}, p(node, path) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN dag ON node = src WHERE NOT list_contains(path, dst) AND len(path) <= {WHOLE_LEN} AND node <> 5)
SELECT array_to_string(list_transform(range(1, len(path)), lambda i: path[i] || '-' || path[i + 1]), ';') AS steps FROM p WHERE node = 5""".replace("hops < 6", f"hops < {WHOLE_LEN}").replace("<= 6", f"<= {WHOLE_LEN}"))
def path_vertices(spark, sf_dir):
    """Each listed path as the ends of its edges."""
    dag = paths.discover_paths(_users(spark, sf_dir), "U0", "U5", WHOLE_LEN)
    pairs = paths.path_vertices(paths.enumerate_paths(dag, "U0", "U5", WHOLE_LEN))
    key = lambda c: F.substring(c, 2, 20)
    return pairs.select(F.array_join(F.transform("pairs", lambda s: F.concat(key(s["start"]), F.lit("-"), key(s["end"]))), ";").alias("steps"))


# -- clocks ------------------------------------------------------------------------------


def _clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = ((F.col("event_id") % 2), (F.col("user_id") % 5), (F.floor("value") % 4))
    return b.table(spark, sf_dir, "events").select("event_id", F.array(*[s.cast("bigint") for s in slots]).alias("clock"))


@query(f"""WITH c AS (SELECT event_id, {CLOCK} AS c FROM events), d AS (SELECT DISTINCT c FROM c),
late AS (SELECT DISTINCT y.c FROM d x JOIN d y ON x.c[1] < y.c[1] OR (x.c[1] = y.c[1] AND x.c[2] <= y.c[2] AND x.c[3] <= y.c[3] AND x.c <> y.c))
SELECT event_id AS id FROM c WHERE c NOT IN (SELECT c FROM late)""")
def vclock_least(spark, sf_dir):
    return clocks.least(_clocks(spark, sf_dir), "event_id")


@query(f"""WITH c AS (SELECT event_id, {CLOCK} AS c FROM events), p AS (SELECT a.event_id, a.c AS x, b.c AS y FROM c a JOIN c b ON b.event_id = a.event_id + 1),
o AS (SELECT *, x[1] < y[1] OR (x[1] = y[1] AND x[2] <= y[2] AND x[3] <= y[3] AND x <> y) AS before FROM p)
SELECT event_id, before, before OR x = y AS not_after, [x[1], x[2], x[3] + 1] AS ticked,
  CASE WHEN x[1] > y[1] THEN x WHEN y[1] > x[1] THEN y ELSE [x[1], greatest(x[2], y[2]), greatest(x[3], y[3])] END AS merged,
  CASE WHEN y[1] > x[1] THEN [y[1], 0, 0] ELSE x END AS renewed FROM o""")
def vclock_ops(spark, sf_dir):
    """Each event's clock against the next one's."""
    c = _clocks(spark, sf_dir).withColumnRenamed("clock", "x")
    both = c.join(c.select((F.col("event_id") - 1).alias("event_id"), F.col("x").alias("y")), "event_id")
    x, y = F.col("x"), F.col("y")
    out = (clocks.before_all(x, F.array(y)).alias("before"), clocks.equal_or_before(x, y).alias("not_after"), clocks.increment(x, 1).alias("ticked"), clocks.merge(x, y).alias("merged"), clocks.new_epoch(x, F.get(y, F.lit(0))).alias("renewed"))
    return both.select("event_id", *out)


# -- the client ----------------------------------------------------------------------------


@query("""SELECT n_nationkey AS nationkey, n_regionkey AS regionkey, CASE WHEN n_nationkey = 3 THEN 'third' ELSE CAST(n_nationkey AS VARCHAR) END AS rank,
  CASE WHEN n_nationkey = 7 THEN 'renamed' ELSE n_name END AS name FROM nation WHERE n_regionkey <> 0 AND n_nationkey <> 24""")
def client_writes(spark, sf_dir):
    """Regions and nations written by a client, then changed; what is aborted, or breaks a rule, changes nothing."""
    client = Client(spark, _folder(spark, "client"))
    regions, nations = (b.table(spark, sf_dir, t).collect() for t in ("region", "nation"))  # 5 and 25 rows
    with client.begin_tx():
        for r in regions:
            client.create_node(f"R{r['r_regionkey']}", [r["r_name"]])
        for n in nations:
            key = n["n_nationkey"]
            client.create_node(f"N{key}")
            client.set_node_property("name", n["n_name"], f"N{key}")
            client.create_edge(f"N{key}", f"R{n['n_regionkey']}", f"e{key}")
            client.set_edge_property(f"e{key}", "rank", key)
    with client.begin_tx():
        client.delete_node(alias=next(r["r_name"] for r in regions if r["r_regionkey"] == 0))
        client.delete_edge("e24")
        client.set_edge_property("e3", "rank", "third")
        client.set_node_property("name", "renamed", "N7")
    client.begin_tx()
    client.delete_node("N1")
    client.abort_tx()
    client.begin_tx()
    client.delete_node("N2")
    client.delete_node("nobody")
    try:
        client.end_tx()
    except AbortedError:
        pass
    snap = client.snapshot()
    rank = snap.edges.value("rank").select("handle", F.col("value").alias("rank"))
    name = snap.nodes.value("name").select(F.col("handle").alias("src"), F.col("value").alias("name"))
    out = snap.edges.rows.select("handle", "src", "dst").join(rank, "handle").join(name, "src")
    return out.select(b.key_of("src").cast("int").alias("nationkey"), b.key_of("dst").cast("int").alias("regionkey"), "rank", "name")


# -- networks -----------------------------------------------------------------------------------


@query("""WITH n AS (SELECT n_nationkey AS k, n_regionkey AS r FROM nation), h AS (SELECT r, (k % 5 - 2) / 3.0::DOUBLE * (1 / (1 + exp(-((k % 7 - 3) / 5.0::DOUBLE * (k / 10.0::DOUBLE))))) AS m FROM n)
SELECT r AS slot, round(1 / (1 + exp(-sum(m))), 6) AS y FROM h GROUP BY 1""")
def nn_infer(spark, sf_dir):
    """A network of nations and regions: one input a nation, one output a region."""
    n = b.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    size = n.count()
    cells, tops = F.concat(F.lit("N"), "k"), F.concat(F.lit("R"), "r")
    link = lambda rows, src, dst, way, w, order: rows.select(F.concat(F.lit(f"{way}-"), src, F.lit("-"), dst).alias("handle"), src.alias("src"), dst.alias("dst"), F.lit(way).alias("dir"), w.cast("string").alias("weight"), order.cast("string").alias("order"))
    first, last, none = F.lit("first"), F.lit("last"), F.lit(None)
    r = n.select("r").distinct()
    edges = link(n, first, cells, "f", (F.col("k") % 7 - 3) / F.lit(5.0), F.col("k")).union(link(n, cells, tops, "f", (F.col("k") % 5 - 2) / F.lit(3.0), F.lit(0))).union(link(r, tops, last, "f", F.lit(1.0), F.col("r")))
    edges = edges.union(link(n, cells, first, "b", none, none)).union(link(n, tops, cells, "b", none, none)).union(link(r, last, tops, "b", none, none))
    always = [F.lit(0).cast("bigint").alias("created_v"), F.lit(None).cast("bigint").alias("deleted_v")]
    nodes = n.select(cells.alias("handle")).union(r.select(tops)).union(frame(spark, "nodes", [("first",), ("last",)]).select("handle"))
    graph = Graph(Elements(nodes.select("handle", *always)), Elements(edges.select("*", *always), None, {c: c for c in ("dir", "weight", "order")}), None, closed=True)
    y = network.infer(graph.at(1), "first", "last", [k / 10 for k in range(size)])
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "slot int, y double").select("slot", F.round("y", 6).alias("y"))


@query("""WITH x AS (SELECT event_id, value / 100 - 1 AS x FROM events)
SELECT event_id, round(x, 6) AS same, CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE 0 END AS step, round(CASE WHEN x > 0 THEN x ELSE 0 END, 6) AS relu, round(exp(-x * x), 6) AS gaussian, round(1 / (1 + exp(-x)), 6) AS sigmoid FROM x""")
def activations(spark, sf_dir):
    x = F.col("value") / 100 - 1
    kinds = {"same": "id", "step": "step", "relu": "relu", "gaussian": "gaussian", "sigmoid": "sigmoid"}
    return b.table(spark, sf_dir, "events").select("event_id", *[(f if c == "step" else F.round(f, 6)).alias(c) for c, f in ((c, scalars.activation(x, k)) for c, k in kinds.items())])


# -- text functions and loaders --------------------------------------------------------------------


@query("""SELECT p_partkey AS partkey, string_split(p_name, ' ') AS parts, replace(p_name, ' ', '') AS bare, round(ln(2 + p_size), 9) AS damped, sha256(p_name) AS program, p_partkey || '_7' AS handle FROM part""")
def text_functions(spark, sf_dir):
    name = F.col("p_name")
    out = (scalars.split_values(name, " ").alias("parts"), scalars.strip_space(name).alias("bare"), F.round(scalars.damped(F.col("p_size")), 9).alias("damped"), scalars.program_id(name).alias("program"), scalars.new_handle(F.col("p_partkey"), 7).alias("handle"))
    return b.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), *out)


@query("""SELECT l_partkey AS partkey, l_orderkey AS doc, CAST(year(l_shipdate) AS VARCHAR) AS date, unnest([l_linenumber, l_suppkey]) AS pos FROM lineitem""")
def locations(spark, sf_dir):
    """Occurrence lists as text, a part's lines each, parsed again."""
    line = b.table(spark, sf_dir, "lineitem")
    one = F.concat(F.lit("("), "l_orderkey", F.lit(", "), F.year("l_shipdate"), F.lit(", ["), "l_linenumber", F.lit(", "), "l_suppkey", F.lit("])"))
    rows = line.groupBy(F.col("l_partkey").alias("partkey")).agg(F.concat_ws(";", F.collect_list(one)).alias("locs"))
    return phrases.parse_locations(rows).select("partkey", "doc", "date", "pos")


@query(f"""WITH {USERS_SQL} SELECT src, dst FROM u""")
def tsv_load(spark, sf_dir):
    """The user pairs as tab-separated text, loaded back."""
    path = _folder(spark, "tsv")
    b.user_pairs(spark, sf_dir).select(F.concat_ws("\t", "src", "dst").alias("value")).write.text(path)
    rows = files.load(spark, path, "tsv").at(1).edges.rows
    return rows.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


@query(f"""WITH {USERS_SQL} SELECT src || ' ' || dst AS line FROM u""")
def coloured_edges(spark, sf_dir):
    """Lines of coloured edges, without the colours."""
    pairs = b.user_pairs(spark, sf_dir).select(F.col("src").alias("u"), F.col("dst").alias("v"))
    return files.coloured_edges(pairs).select(F.regexp_replace("value", " color red$", "").alias("line"))

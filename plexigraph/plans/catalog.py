"""The query catalogue over the relational tables, with each query's SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import clocks
from ..functions.predicates import Pred, Relation
from ..operators import access, local, network, ordering, paths, phrases, placement, star, vertex
from ..operators.traverse import Traversal
from ..scratch import importable, shared_dir
from ..sources import binding as b, files
from ..sources.files import clean_edges
from ..store import Store
from ..streaming.ingest import degrees, windowed_writes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

USERS_SQL = """
u AS (SELECT DISTINCT src, dst FROM (
        SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS dst FROM events)
      WHERE dst IS NOT NULL AND src <> dst)"""


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and the DuckDB SQL of its result."""

    def add(f: Query) -> Query:
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


def _sales(spark: SparkSession, sf_dir: str, version: int = b.NOW):
    return b.sales_graph(spark, sf_dir).at(version)


def _users(spark: SparkSession, sf_dir: str):
    return b.user_graph(spark, sf_dir).at(b.NOW)


# -- traversal -------------------------------------------------------------------


def _returned(spark: SparkSession, sf_dir: str) -> Traversal:
    snap = _sales(spark, sf_dir)
    starts = snap.nodes.having({"type": "customer", "mktsegment": "BUILDING"})
    t = Traversal(snap, starts, {"type": "customer", "mktsegment": "BUILDING"})
    return t.out_edge({"type": "placed"}).node({"type": "order", "status": "F"}).out_edge({"type": "contains", "returnflag": "R"})


@query("""SELECT DISTINCT l_partkey AS partkey FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND l_returnflag = 'R'""")
def traverse_parts(spark, sf_dir):
    return _returned(spark, sf_dir).node().execute().select(b.key_of("handle").alias("partkey"))


@query("""WITH a AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
o AS (SELECT o_orderkey FROM orders JOIN a ON o_custkey = c_custkey WHERE o_orderstatus = 'F')
SELECT 'C' AS kind, c_custkey AS id FROM a UNION SELECT 'O', o_orderkey FROM o
UNION SELECT 'P', l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'""")
def traverse_collect_nodes(spark, sf_dir):
    return _returned(spark, sf_dir).node().collect_nodes().select(F.substring("handle", 1, 1).alias("kind"), b.key_of("handle").alias("id"))


@query("""SELECT DISTINCT l_orderkey AS orderkey, l_linenumber AS linenumber FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND l_returnflag = 'R'""")
def traverse_edge_terminal(spark, sf_dir):
    part = F.split("handle", "-")
    out = _returned(spark, sf_dir).execute()
    return out.select(F.substring(F.get(part, F.lit(0)), 2, 20).cast("bigint").alias("orderkey"), F.get(part, F.lit(1)).cast("int").alias("linenumber")).distinct()


@query("""SELECT DISTINCT o_orderkey AS orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_name = (SELECT min(c_name) FROM customer)""")
def traverse_alias_start(spark, sf_dir):
    first = b.table(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0]
    return Traversal(_sales(spark, sf_dir), [first]).out_edge({"type": "placed"}).node().execute().select(b.key_of("handle").alias("orderkey"))


# -- reads ------------------------------------------------------------------------


@query("""SELECT c_custkey AS custkey, 'mktsegment' AS key, c_mktsegment AS value FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer""")
def node_get_props(spark, sf_dir):
    snap = _sales(spark, sf_dir)
    rows = snap.nodes.having({"type": "customer"})
    return snap.nodes.properties(rows, ["name", "mktsegment"]).select(b.key_of("handle").alias("custkey"), "key", "value")


@query("""SELECT l_orderkey AS orderkey, l_partkey AS partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' AND l_linestatus = 'F' GROUP BY ALL""")
def edge_get_filtered(spark, sf_dir):
    rows = access.get_edges(_sales(spark, sf_dir), props={"type": "contains", "returnflag": "A", "linestatus": "F"})
    return rows.groupBy(b.key_of("src").alias("orderkey"), b.key_of("dst").alias("partkey")).agg(F.count("*").alias("n"))


@query("""SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1""")
def edge_count_by_node(spark, sf_dir):
    return access.edge_count(_sales(spark, sf_dir), {"type": "placed"}).select(b.key_of("src").alias("custkey"), "n")


@query("""SELECT o_custkey AS custkey, o_orderkey AS orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY 'p' || o_orderkey) AS r FROM orders) WHERE r <= 3""")
def read_n_edges(spark, sf_dir):
    return access.read_n_edges(_sales(spark, sf_dir), 3, {"type": "placed"}).select(b.key_of("src").alias("custkey"), b.key_of("dst").alias("orderkey"))


@query("""SELECT o_custkey AS custkey, list(o_orderkey ORDER BY o_orderkey) AS orders, any_value(c_name) AS name FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1""")
def node_get_edges(spark, sf_dir):
    snap = _sales(spark, sf_dir)
    own = snap.edges.having({"type": "placed"}).groupBy("src").agg(F.sort_array(F.collect_list(b.key_of("dst"))).alias("orders"))
    names = snap.nodes.value("name", snap.nodes.having({"type": "customer"}))
    return own.join(names, own["src"] == names["handle"]).select(b.key_of("src").alias("custkey"), "orders", F.col("value").alias("name"))


for _rel, _val, _sql in (
    (Relation.EQUALS, "Brand#11", "p_brand = 'Brand#11'"),
    (Relation.LESS, "Brand#2", "p_brand < 'Brand#2'"),
    (Relation.GREATER, "Brand#3", "p_brand > 'Brand#3'"),
    (Relation.LESS_EQUAL, "Brand#22", "p_brand <= 'Brand#22'"),
    (Relation.GREATER_EQUAL, "Brand#33", "p_brand >= 'Brand#33'"),
    (Relation.STARTS_WITH, "Brand#1", "starts_with(p_brand, 'Brand#1')"),
    (Relation.ENDS_WITH, "3", "ends_with(p_brand, '3')"),
    (Relation.CONTAINS, "#2", "contains(p_brand, '#2')"),
):

    def _pred(spark, sf_dir, rel=_rel, val=_val):
        rows = _sales(spark, sf_dir).nodes.having([Pred("brand", rel, val)])
        return rows.select(b.key_of("handle").alias("partkey"), "brand")

    query(f"SELECT p_partkey AS partkey, p_brand AS brand FROM part WHERE {_sql}", f"pred_{_rel.value}")(_pred)


@query("""SELECT p_partkey AS partkey FROM part WHERE p_brand < 'Brand#4' AND p_brand > 'Brand#2' AND contains(p_type, 'S')""")
def pred_conjunction(spark, sf_dir):
    req = [Pred("brand", Relation.LESS, "Brand#4"), Pred("brand", Relation.GREATER, "Brand#2"), Pred("ptype", Relation.CONTAINS, "S")]
    return _sales(spark, sf_dir).nodes.having(req).select(b.key_of("handle").alias("partkey"))


@query("""SELECT CAST(k % 8 AS INTEGER) AS shard, count(*) AS n FROM (SELECT c_custkey AS k FROM customer UNION ALL SELECT o_orderkey FROM orders UNION ALL SELECT p_partkey FROM part) GROUP BY 1""")
def node_count_by_shard(spark, sf_dir):
    return access.node_count(_sales(spark, sf_dir), place=(b.key_of("handle") % 8).cast("int"))


@query("""SELECT (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) AS n""")
def edge_total(spark, sf_dir):
    return access.edge_total(_sales(spark, sf_dir))


@query("""WITH d AS (SELECT o_custkey, count(*) AS degree FROM orders GROUP BY 1) SELECT degree, count(*) AS n FROM d GROUP BY 1""")
def degree_histogram(spark, sf_dir):
    return access.degree_histogram(_sales(spark, sf_dir), {"type": "placed"})


@query(f"""WITH {USERS_SQL} SELECT src, dst, CAST(r AS INTEGER) AS rank FROM (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY 1 + (src * 7 + dst * 13) % 20 DESC, 'e' || src || '-' || dst) AS r FROM u) WHERE r <= 3""")
def topk_neighbors(spark, sf_dir):
    return access.top_neighbors(_users(spark, sf_dir), "weight", 3).select(b.key_of("src").alias("src"), b.key_of("dst").alias("dst"), "rank")


# -- neighbourhoods ------------------------------------------------------------------


@query(f"""WITH {USERS_SQL} SELECT DISTINCT a.src AS center, c.dst AS node, 'user ' || c.dst AS value FROM u a JOIN u c ON a.dst = c.src""")
def two_neighborhood(spark, sf_dir):
    return local.two_neighborhood(_users(spark, sf_dir), "name").select(b.key_of("center").alias("center"), b.key_of("node").alias("node"), "value")


@query(f"""WITH {USERS_SQL}, k AS (SELECT src, count(*) AS k FROM u GROUP BY 1),
w AS (SELECT a.src, count(*) AS closed FROM u a JOIN u b ON a.dst = b.src JOIN u c ON c.src = a.src AND c.dst = b.dst GROUP BY 1)
SELECT k.src AS user_id, coalesce(closed, 0) AS closed, k, round(CASE WHEN k < 2 THEN 0 ELSE coalesce(closed, 0) / (k * (k - 1)) END, 9) AS coefficient FROM k LEFT JOIN w USING (src)""")
def clustering_all(spark, sf_dir):
    out = local.clustering(_users(spark, sf_dir))
    return out.select(b.key_of("handle").alias("user_id"), "closed", "k", F.round("coefficient", 9).alias("coefficient"))


@query(f"""WITH {USERS_SQL}, p AS (SELECT DISTINCT least(src, dst) AS x, greatest(src, dst) AS y FROM u)
SELECT count(*) AS n FROM p a JOIN p b ON a.y = b.x JOIN p c ON c.x = a.x AND c.y = b.y""")
def triangle_count(spark, sf_dir):
    return local.triangle_count(_users(spark, sf_dir))


# -- paths -----------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {USERS_SQL}, r(node) AS (SELECT CAST(0 AS BIGINT) UNION SELECT dst FROM r JOIN u ON node = src) SELECT node AS user_id FROM r""")
def reach_set(spark, sf_dir):
    return paths.reach_set(_users(spark, sf_dir), b.one(spark, "U0")).select(b.key_of("handle").alias("user_id"))


@query(f"""WITH RECURSIVE {USERS_SQL}, r(node, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, hops + 1 FROM r JOIN u ON node = src WHERE hops < 3)
SELECT node AS user_id, min(hops) AS hops FROM r GROUP BY 1""")
def n_hop_set(spark, sf_dir):
    return paths.reach_set(_users(spark, sf_dir), b.one(spark, "U0"), max_hops=3).select(b.key_of("handle").alias("user_id"), "hops")


@query(f"""WITH RECURSIVE {USERS_SQL}, r(node, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, hops + 1 FROM r JOIN u ON node = src WHERE hops < 8)
SELECT node AS user_id, min(hops) AS hops FROM r GROUP BY 1""")
def hops(spark, sf_dir):
    return paths.reach_set(_users(spark, sf_dir), b.one(spark, "U0")).select(b.key_of("handle").alias("user_id"), "hops")


@query(f"""WITH RECURSIVE {USERS_SQL}, e AS (SELECT src, dst, 1 + (src * 7 + dst * 13) % 20 AS w FROM u),
r(node, cost) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, cost + w FROM r JOIN e ON node = src WHERE dst <> 0 AND cost + w <= 40)
SELECT node AS user_id, min(cost) AS cost FROM r GROUP BY 1""")
def shortest_cost(spark, sf_dir):
    snap = _users(spark, sf_dir)
    return paths.best_costs(paths.weights(snap, "weight"), "U0").select(b.key_of("handle").alias("user_id"), "cost")


@query(f"""WITH RECURSIVE {USERS_SQL}, e AS (SELECT src, dst, 1 + (src * 7 + dst * 13) % 20 AS w FROM u),
r(node, cost) AS (SELECT CAST(0 AS BIGINT), CAST(21 AS BIGINT) UNION SELECT dst, least(cost, w) FROM r JOIN e ON node = src WHERE dst <> 0)
SELECT node AS user_id, max(cost) AS cost FROM r WHERE node <> 0 GROUP BY 1""")
def widest_cost(spark, sf_dir):
    snap = _users(spark, sf_dir)
    return paths.best_costs(paths.weights(snap, "weight"), "U0", widest=True).filter("cost is not null").select(b.key_of("handle").alias("user_id"), "cost")


#: Edges of the paths that are listed: their number grows as the degree to this power.
WHOLE_LEN = 4


DAG_SQL = f"""WITH RECURSIVE {USERS_SQL},
f(node, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, hops + 1 FROM f JOIN u ON node = src WHERE hops < 6 AND node <> 5),
g(node, hops) AS (SELECT CAST(5 AS BIGINT), 0 UNION SELECT src, hops + 1 FROM g JOIN u ON node = dst WHERE hops < 6 AND src <> 5),
a AS (SELECT node, min(hops) AS h FROM f GROUP BY 1), z AS (SELECT node, min(hops) AS t FROM g GROUP BY 1),
dag AS (SELECT src, dst FROM u JOIN a ON a.node = src JOIN z ON z.node = dst WHERE src <> 5 AND h + 1 + t <= 6)"""


@query(f"{DAG_SQL} SELECT src, dst FROM dag")
def discover_dag(spark, sf_dir):
    found = paths.discover_paths(_users(spark, sf_dir), "U0", "U5", 6)
    return found.select(b.key_of("src").alias("src"), b.key_of("dst").alias("dst"))


@query(f"""{DAG_SQL}, p(node, path) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)] UNION ALL SELECT dst, list_append(path, dst) FROM p JOIN dag ON node = src WHERE NOT list_contains(path, dst) AND len(path) <= {WHOLE_LEN} AND node <> 5)
SELECT array_to_string(path, '>') AS path FROM p WHERE node = 5""".replace("hops < 6", f"hops < {WHOLE_LEN}").replace("<= 6", f"<= {WHOLE_LEN}"))
def enumerate_paths(spark, sf_dir):
    dag = paths.discover_paths(_users(spark, sf_dir), "U0", "U5", WHOLE_LEN)
    found = paths.enumerate_paths(dag, "U0", "U5", WHOLE_LEN)
    return found.select(F.array_join(F.transform("path", lambda x: F.substring(x, 2, 20)), ">").alias("path"))


# products of four confidences have eight digits: rounded there, none is a tie
@query(f"""WITH RECURSIVE {USERS_SQL}, e AS (SELECT src, dst, round(0.05 + (src * 3 + dst * 5) % 19 / 20, 2) AS c FROM u),
p(node, path, conf) AS (SELECT CAST(0 AS BIGINT), [CAST(0 AS BIGINT)], 1.0::DOUBLE
  UNION ALL SELECT dst, list_append(path, dst), conf * c FROM p JOIN e ON node = src WHERE NOT list_contains(path, dst) AND node <> 5 AND len(path) <= {WHOLE_LEN} AND (dst = 5 OR conf * c > 0.001))
SELECT array_to_string(path, '>') AS path, round(conf, 8) AS confidence FROM p WHERE node = 5""")
def confidence_paths(spark, sf_dir):
    found = paths.cause_and_effect(_users(spark, sf_dir), "U0", "U5", "confidence", 0.001, max_hops=WHOLE_LEN)
    return found.select(F.array_join(F.transform("path", lambda x: F.substring(x, 2, 20)), ">").alias("path"), F.round("confidence", 8).alias("confidence"))


# -- words, stars, networks ------------------------------------------------------------------


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM w)
SELECT DISTINCT a.doc_id AS doc FROM t a JOIN t b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1 JOIN t c ON c.doc_id = a.doc_id AND c.pos = a.pos + 2
WHERE a.word = 'licensed' AND b.word = 'under' AND c.word = 'the'""")
def ngram_phrase(spark, sf_dir):
    return phrases.phrase(phrases.word_pairs(b.table(spark, sf_dir, "documents")), ["licensed", "under", "the"])


@query("""SELECT l_orderkey AS orderkey, list(DISTINCT l_partkey ORDER BY l_partkey) AS parts, count(DISTINCT l_partkey) + 2 AS num_nodes_read FROM lineitem GROUP BY 1
UNION ALL SELECT o_orderkey, [], 1 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def star_block(spark, sf_dir):
    snap = _sales(spark, sf_dir)
    out = star.get_block(snap, snap.nodes.having({"type": "order"}).select("handle"), prefix="l")
    return out.select(b.key_of("handle").alias("orderkey"), F.sort_array(F.transform("txs", lambda x: F.substring(x, 2, 20).cast("bigint"))).alias("parts"), "num_nodes_read")


@query("""SELECT DISTINCT o_custkey AS custkey, o_orderkey AS orderkey FROM orders""")
def star_address(spark, sf_dir):
    snap = _sales(spark, sf_dir)
    out = star.get_address(snap, snap.nodes.having({"type": "customer"}).select("handle"))
    return out.select(b.key_of("address").alias("custkey"), b.key_of("tx").alias("orderkey"))


@query("""SELECT l_partkey AS dst, round(1 / (1 + exp(-sum((l_discount - 0.05) * (o_totalprice / 100000)))), 6) AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def nn_layer(spark, sf_dir):
    w = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), (F.col("l_discount") - 0.05).alias("w"))
    x = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), (F.col("o_totalprice") / 100000).alias("x"))
    return network.dense_layer(w, x, "sigmoid", 6)


# -- versions, clocks, transactions --------------------------------------------------------------


@query("""SELECT event_id, o_orderkey AS orderkey FROM events JOIN orders ON o_orderkey = event_id + 1 AND date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) < event_id % 2400""")
def asof_lookup(spark, sf_dir):
    """As-of lookups of many (handle, version) pairs, one per event."""
    e = b.table(spark, sf_dir, "events")
    asked = e.select(F.concat(F.lit("O"), (F.col("event_id") + 1).cast("string")).alias("handle"), (F.col("event_id") % 2400).alias("version"), "event_id")
    found = access.versions_at(b.sales_graph(spark, sf_dir), asked.select("handle", "version"))
    return found.select((b.key_of("handle") - 1).alias("event_id"), b.key_of("handle").alias("orderkey"))


@query("""SELECT o_orderkey AS orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) < 900
WHERE date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) < 900 GROUP BY 1""")
def asof_orders(spark, sf_dir):
    snap = _sales(spark, sf_dir, 900)
    orders = snap.nodes.having({"type": "order"}).select("handle")
    n = access.edge_count(snap, {"type": "contains"})
    return orders.join(n, orders["handle"] == n["src"], "left").select(b.key_of("handle").alias("orderkey"), F.coalesce("n", F.lit(0)).alias("n"))


@query("""SELECT 'node' AS kind, 'created' AS change, count(*) AS n FROM orders WHERE date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) BETWEEN 101 AND 200
UNION ALL SELECT 'edge', 'created', (SELECT count(*) FROM orders WHERE date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) BETWEEN 101 AND 200) + (SELECT count(*) FROM lineitem WHERE date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) BETWEEN 101 AND 200)""")
def snapshot_diff(spark, sf_dir):
    return b.sales_graph(spark, sf_dir).changes(100, 200).groupBy("kind", "change").agg(F.count("*").alias("n"))


CLOCK = "[CAST(event_id % 2 AS BIGINT), user_id % 5, CAST(floor(value) AS BIGINT) % 4]"


@query(f"""WITH c AS (SELECT event_id, {CLOCK} AS c FROM events), p AS (SELECT a.event_id, a.c AS x, b.c AS y FROM c a JOIN c b ON b.event_id = a.event_id + 1)
SELECT event_id, CASE WHEN x[1] < y[1] THEN 0 WHEN x[1] > y[1] THEN 1 WHEN (x[2] < y[2] OR x[3] < y[3]) AND (x[2] > y[2] OR x[3] > y[3]) THEN -1
  WHEN x[2] < y[2] OR x[3] < y[3] THEN 0 WHEN x[2] > y[2] OR x[3] > y[3] THEN 1 ELSE 2 END AS ord FROM p""")
def vclock_compare(spark, sf_dir):
    e = b.table(spark, sf_dir, "events").select("event_id", F.array((F.col("event_id") % 2).cast("bigint"), (F.col("user_id") % 5).cast("bigint"), (F.floor("value") % 4).cast("bigint")).alias("x"))
    after = e.select((F.col("event_id") - 1).alias("event_id"), F.col("x").alias("y"))
    return e.join(after, "event_id").select("event_id", clocks.compare(F.col("x"), F.col("y")).alias("ord"))


@query(f"""WITH RECURSIVE {USERS_SQL}, e AS (SELECT src, dst FROM u WHERE src < dst),
r(a, node) AS (SELECT DISTINCT user_id, user_id FROM events UNION SELECT a, dst FROM r JOIN e ON node = src),
n AS (SELECT DISTINCT user_id AS a, (user_id * 7 + 3) % (SELECT count(DISTINCT user_id) FROM events) AS b FROM events), k AS (SELECT DISTINCT user_id AS id FROM events)
SELECT n.a, n.b, CASE WHEN n.b NOT IN (SELECT id FROM k) THEN 'NOEXIST' WHEN n.a = n.b THEN 'CONCURRENT'
  WHEN EXISTS (SELECT 1 FROM r WHERE r.a = n.a AND r.node = n.b) THEN 'BEFORE' WHEN EXISTS (SELECT 1 FROM r WHERE r.a = n.b AND r.node = n.a) THEN 'AFTER' ELSE 'CONCURRENT' END AS ord FROM n""")
def event_order(spark, sf_dir):
    users = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("event_id")).distinct()
    edges = b.user_pairs(spark, sf_dir).filter("src < dst")
    pairs = users.select(F.col("event_id").alias("a"), ((F.col("event_id") * 7 + 3) % users.count()).alias("b"))
    return ordering.query_order(users, edges, pairs)


@query("""SELECT c_custkey AS custkey, CASE WHEN c_acctbal > 5000 THEN 'RICH' ELSE c_mktsegment END AS segment, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders
FROM customer WHERE c_acctbal >= 0""")
def tx_apply(spark, sf_dir):
    """Loads customers and orders, then one batch: poor customers go, rich ones get another segment."""
    store = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}")
    g = b.sales_graph(spark, sf_dir)
    kinds = F.col("type").isin("customer", "order")
    nodes = b.Elements(g.nodes.rows.filter(kinds), None, {"mktsegment": "mktsegment"})
    edges = b.Elements(g.edges.rows.filter("type = 'placed'"), None, {})
    store.load(b.Graph(nodes, edges, None, True))
    c = b.table(spark, sf_dir, "customer")
    none = F.lit(None).cast("string")
    op = lambda cond, name, key, value: c.filter(cond).select(F.col("c_custkey").alias("tx_id"), F.lit(0).alias("seq"), F.lit(name).alias("op"), none.alias("handle"), b.handle("C", "c_custkey").alias("handle1"), none.alias("handle2"), none.alias("alias1"), none.alias("alias2"), F.lit(key).cast("string").alias("key"), F.lit(value).cast("string").alias("value"))
    ops = op("c_acctbal < 0", "NODE_DELETE", None, None).unionByName(op("c_acctbal > 5000", "NODE_SET_PROPERTY", "mktsegment", "RICH"))
    number, _ = store.commit(ops)
    snap = store.at(number)
    own = snap.nodes.rows.filter(F.col("handle").startswith("C"))
    segments = snap.nodes.value("mktsegment", own)
    n = access.edge_count(snap).withColumnRenamed("src", "handle")
    return segments.join(n, "handle", "left").select(b.key_of("handle").alias("custkey"), F.col("value").alias("segment"), F.coalesce("n", F.lit(0)).alias("n_orders"))


# -- programs, placement, streams --------------------------------------------------------------------


def _least(vertex_, messages, params):
    """Keeps the least number heard of and passes it on when it falls."""
    heard = min(messages)
    if vertex_.state is not None and vertex_.state <= heard:
        return vertex.Turn(vertex_.state)
    return vertex.Turn(heard, [(e["dst"], heard) for e in vertex_.edges], [heard])


@query(f"""WITH RECURSIVE {USERS_SQL}, r(a, node) AS (SELECT DISTINCT user_id, user_id FROM events UNION SELECT a, dst FROM r JOIN u ON node = src)
SELECT node AS user_id, min(a) AS least FROM r GROUP BY 1""")
def vertex_program_least(spark, sf_dir):
    """A vertex program: the least user that reaches each user."""
    snap = _users(spark, sf_dir)
    starts = snap.nodes.rows.select("handle", b.key_of("handle").cast("string").alias("payload"))
    least = lambda c: F.min(c.cast("bigint")).cast("string")
    out = vertex.run_program(snap, _least, starts, combine=least)
    return out.groupBy(b.key_of("handle").alias("user_id")).agg(F.min(F.col("payload").cast("bigint")).alias("least"))


@query()
def ldg_assign(spark, sf_dir):
    importable(spark)
    return placement.greedy(_users(spark, sf_dir), 8).select(b.key_of("handle").alias("user_id"), "shard")


@query("""WITH n AS (SELECT DISTINCT user_id FROM events) SELECT CAST((row_number() OVER (ORDER BY 'U' || user_id) - 1) % 8 AS INTEGER) AS shard, user_id FROM n""")
def round_robin(spark, sf_dir):
    return placement.round_robin(_users(spark, sf_dir), 8).select("shard", b.key_of("handle").alias("user_id"))


@query(f"""WITH {USERS_SQL}, n AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS i FROM (SELECT src AS id FROM u UNION SELECT dst FROM u))
SELECT a.i AS u, z.i AS v FROM u JOIN n a ON a.id = src JOIN n z ON z.id = dst""")
def renumbered_edges(spark, sf_dir):
    return clean_edges(b.user_pairs(spark, sf_dir))


@query("""SELECT user_id AS src, count(*) AS degree FROM events GROUP BY 1""")
def stream_degrees(spark, sf_dir):
    """The events table as a stream; the last state of each vertex's running degree."""
    importable(spark)
    static = b.table(spark, sf_dir, "events")
    name = f"degrees_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(static.schema).parquet(_folder(spark, sf_dir, "events")).select(F.col("user_id").alias("src"))
    out = f"{shared_dir(spark)}/{name}"
    run = degrees(stream).writeStream.outputMode("update").foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("append").parquet(f"{out}/rows")).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    rows = spark.read.parquet(f"{out}/rows")
    return rows.groupBy("src").agg(F.max("degree").alias("degree"))


# -- files ----------------------------------------------------------------------------------------


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("""SELECT n_nationkey AS nationkey, n_name AS name, r_name AS region FROM nation JOIN region ON r_regionkey = n_regionkey""")
def graphml_load(spark, sf_dir):
    """Nations and regions written as GraphML and loaded back."""
    n, r = b.table(spark, sf_dir, "nation"), b.table(spark, sf_dir, "region")
    node = lambda df, letter, key, name: df.select(F.format_string('<node id="%s%d"><data key="name">%s</data></node>', F.lit(letter), key, name).alias("value"))
    edges = n.select(F.format_string('<edge source="N%d" target="R%d"><data key="type">in</data></edge>', "n_nationkey", "n_regionkey").alias("value"))
    path = _scratch(spark, "graphml")
    lines = node(n, "N", "n_nationkey", "n_name").union(node(r, "R", "r_regionkey", "r_name")).union(edges)
    # one document with one root; the two tables have a fixed, small size
    body = F.array_join(F.sort_array(F.collect_list("value")), "\n")
    lines.agg(F.concat(F.lit("<graphml><graph>\n"), body, F.lit("\n</graph></graphml>")).alias("value")).write.text(path)
    snap = files.load(spark, path, "graphml").at(1)
    name = snap.nodes.properties(keys=["name"]).select("handle", "value")
    e = snap.edges_with({"type": "in"})
    a, z = name.withColumnsRenamed({"handle": "src", "value": "name"}), name.withColumnsRenamed({"handle": "dst", "value": "region"})
    return e.join(a, "src").join(z, "dst").select(b.key_of("src").cast("int").alias("nationkey"), "name", "region")


@query(f"""WITH {USERS_SQL} SELECT src, dst FROM u""")
def snap_load(spark, sf_dir):
    """The user pairs as an edge list with a comment, loaded back."""
    path = _scratch(spark, "snap")
    pairs = b.user_pairs(spark, sf_dir)
    lines = pairs.select(F.concat_ws("\t", "src", "dst").alias("value"))
    lines.union(spark.createDataFrame([("# a comment",)], "value string")).write.text(path)
    return files.load(spark, path, "snap").at(1).edges.rows.select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))


@query(f"""WITH {USERS_SQL} SELECT src, dst, CAST(1 + (src * 7 + dst * 13) % 20 AS VARCHAR) AS weight FROM u""")
def property_edge_load(spark, sf_dir):
    """The weighted user pairs as ``u v weight w`` lines, loaded back."""
    path = _scratch(spark, "pairs")
    b.user_pairs(spark, sf_dir).select(F.concat_ws(" ", "src", "dst", F.lit("weight"), 1 + (F.col("src") * 7 + F.col("dst") * 13) % 20).alias("value")).write.text(path)
    snap = files.load(spark, path, "property_edges").at(1)
    return snap.edges.rows.join(snap.edges.value("weight"), "handle").select(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"), F.col("value").alias("weight"))


@query("""SELECT o_custkey AS custkey, count(*) AS n FROM orders GROUP BY 1""")
def bulk_load(spark, sf_dir):
    """The sales graph written in hash buckets and read back."""
    path = _scratch(spark, "bulk")
    files.write_graph(b.sales_graph(spark, sf_dir), path, buckets=8)
    rows = spark.read.parquet(f"{path}/edges").filter("type = 'placed'")
    return rows.groupBy(b.key_of("src").alias("custkey")).agg(F.count("*").alias("n"))


# -- single values and pairs ---------------------------------------------------------------------------


@query(f"""WITH {USERS_SQL} SELECT src, dst, 'weight' AS key, CAST(1 + (src * 7 + dst * 13) % 20 AS VARCHAR) AS value FROM u""")
def edge_props_read(spark, sf_dir):
    snap = _users(spark, sf_dir)
    found = access.edge_props(snap, keys=["weight"]).select("handle", "key", "value")
    return found.join(snap.edges.rows.select("handle", "src", "dst"), "handle").select(b.key_of("src").alias("src"), b.key_of("dst").alias("dst"), "key", "value")


@query("""SELECT 'C' AS kind, c_custkey AS id, '' AS brand FROM customer UNION ALL SELECT 'O', o_orderkey, '' FROM orders UNION ALL SELECT 'P', p_partkey, p_brand FROM part""")
def scalar_property(spark, sf_dir):
    """A property of every node, the empty string where there is none."""
    return _sales(spark, sf_dir).nodes.value("brand").select(F.substring("handle", 1, 1).alias("kind"), b.key_of("handle").alias("id"), F.col("value").alias("brand"))


@query("""SELECT event_id, event_id IN (SELECT o_orderkey FROM orders) AS there FROM events""")
def edge_exists(spark, sf_dir):
    asked = b.table(spark, sf_dir, "events").select(F.concat(F.lit("p"), F.col("event_id").cast("string")).alias("handle"))
    return access.edge_exists(_sales(spark, sf_dir), asked).select(b.key_of("handle").alias("event_id"), F.col("exists").alias("there"))


@query(f"""WITH RECURSIVE {USERS_SQL}, r(node, hops) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, hops + 1 FROM r JOIN u ON node = src WHERE hops < 12)
SELECT count(*) > 0 AS reachable, min(hops) AS hops FROM r WHERE node = 5""")
def reach_path(spark, sf_dir):
    return paths.reach(_users(spark, sf_dir), "U0", "U5").select("reachable", "hops")


@query(f"""WITH RECURSIVE {USERS_SQL}, e AS (SELECT src, dst, 1 + (src * 7 + dst * 13) % 20 AS w FROM u),
r(node, cost) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT) UNION SELECT dst, cost + w FROM r JOIN e ON node = src WHERE cost + w <= 40)
SELECT coalesce(min(cost), 0) AS cost FROM r WHERE node = 5""")
def shortest_path(spark, sf_dir):
    return paths.weighted_path(_users(spark, sf_dir), "U0", "U5", "weight").select("cost")


@query(f"""WITH RECURSIVE {USERS_SQL}, e AS (SELECT src, dst, 1 + (src * 7 + dst * 13) % 20 AS w FROM u),
r(node, cost) AS (SELECT CAST(0 AS BIGINT), CAST(21 AS BIGINT) UNION SELECT dst, least(cost, w) FROM r JOIN e ON node = src)
SELECT max(cost) AS cost FROM r WHERE node = 5""")
def widest_path(spark, sf_dir):
    return paths.weighted_path(_users(spark, sf_dir), "U0", "U5", "weight", widest=True).select("cost")


@query("""SELECT o_orderkey AS orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS consumed FROM orders""")
def star_tx(spark, sf_dir):
    """Orders as transactions: each is consumed by the customer's next one."""
    o = b.table(spark, sf_dir, "orders")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    always = [F.lit(0).cast("bigint").alias("created_v"), F.lit(None).cast("bigint").alias("deleted_v")]
    nodes = o.select(b.handle("O", "o_orderkey").alias("handle"), *always).union(b.table(spark, sf_dir, "customer").select(b.handle("C", "c_custkey"), *always))
    key = F.col("o_orderkey").cast("string")
    out = o.select(F.concat(F.lit(star.TX_OUT), key).alias("handle"), b.handle("O", "o_orderkey").alias("src"), b.handle("C", "o_custkey").alias("dst"), *always)
    spent = o.withColumn("next", after).filter("next is not null").select(F.concat(F.lit(star.CONSUMED_BY), key), b.handle("O", "o_orderkey"), b.handle("O", "next"), *always)
    snap = b.Graph(b.Elements(nodes), b.Elements(out.union(spent)), None, True).at(1)
    rows = star.get_tx(snap).filter(F.col("handle").startswith(star.TX_OUT))
    return rows.select(b.key_of("src").alias("orderkey"), b.key_of("consumed").alias("consumed"))


@query(f"""WITH c AS (SELECT {CLOCK} AS c FROM events) SELECT [min(c[1]), min(c[2]), min(c[3])] AS clock FROM c""")
def vclock_floor(spark, sf_dir):
    return clocks.floor(_clocks(spark, sf_dir))


def _clocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", F.array((F.col("event_id") % 2).cast("bigint"), (F.col("user_id") % 5).cast("bigint"), (F.floor("value") % 4).cast("bigint")).alias("clock"))


@query(f"""WITH c AS (SELECT event_id, user_id % 2 AS owner, {CLOCK} AS c FROM events), n AS (
SELECT event_id AS src, lead(event_id) OVER (PARTITION BY owner, c[1] ORDER BY c[owner + 2], event_id) AS dst FROM c) SELECT * FROM n WHERE dst IS NOT NULL""")
def event_chain(spark, sf_dir):
    """Each event before the next of its clock owner and epoch."""
    return ordering.chain_events(_clocks(spark, sf_dir).withColumn("owner", (F.col("user_id") % 2).cast("int")))


@query("""SELECT date_trunc('hour', ts) AS start, event_type AS op, count(*) AS n FROM events GROUP BY 1, 2""")
def stream_windows(spark, sf_dir):
    """Events as a stream, counted by hour and type as the watermark passes; a last late row closes all windows."""
    static = b.table(spark, sf_dir, "events")
    out = _scratch(spark, "windows")
    closing = static.orderBy("ts").limit(1).withColumn("ts", F.col("ts") + F.expr("INTERVAL 100 YEARS")).withColumn("event_type", F.lit("end"))

    def drain(source: DataFrame) -> None:
        run = windowed_writes(source, "ts", "1 hour", "0 seconds").writeStream.outputMode("append").format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
        run.awaitTermination()

    copy = f"{out}/in"
    static.write.parquet(copy)
    stream = spark.readStream.schema(static.schema).parquet(copy).select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("op"))
    drain(stream)
    closing.write.mode("append").parquet(copy)
    drain(stream)
    return spark.read.parquet(f"{out}/rows").filter("op != 'end'").select(F.col("start").cast("timestamp_ntz").alias("start"), "op", "n")


def _folder(spark: SparkSession, sf_dir: str, name: str) -> str:
    """A folder for the stream source: the table itself if it is one, else a copy in the shared folder."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    path = fs.Path(f"{sf_dir}/{name}.parquet")
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.getFileStatus(path).isDirectory():
        return f"{sf_dir}/{name}.parquet"
    copy = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    b.table(spark, sf_dir, name).write.parquet(copy)
    return copy


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse_parts(spark, sf_dir)


__all__ = ["ORACLES", "QUERIES", "flagship"]

"""Relational tables as a graph: customers, orders and parts; and users by their events.

Handles are a letter and a key.  Properties are wide columns, so their predicates and the
columns a query needs reach the Parquet scans, and branches of the union that cannot
match are pruned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..model import Elements, Graph

NODE_WIDE = {"type": "STRING", "name": "STRING", "mktsegment": "STRING", "acctbal": "DOUBLE", "nationkey": "INT", "status": "STRING", "totalprice": "DOUBLE", "priority": "STRING", "brand": "STRING", "ptype": "STRING", "size": "INT"}
EDGE_WIDE = {"type": "STRING", "returnflag": "STRING", "linestatus": "STRING", "quantity": "DOUBLE"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def handle(letter: str, key: str) -> Column:
    return F.concat(F.lit(letter), F.col(key).cast("string"))


def key_of(handle_col: str) -> Column:
    """The integer key of a handle."""
    return F.substring(handle_col, 2, 20).cast("bigint")


def day(col: str) -> Column:
    """Days since 1995-01-01, as a version."""
    return F.datediff(F.col(col).cast("date"), F.lit("1995-01-01").cast("date")).cast("bigint")


def _rows(df: DataFrame, ids: list[Column], created: Column, wide: dict[str, str], given: dict[str, Column]) -> DataFrame:
    props = [given.get(k, F.lit(None)).cast(t).alias(k) for k, t in wide.items()]
    return df.select(*ids, created.cast("bigint").alias("created_v"), F.lit(None).cast("bigint").alias("deleted_v"), *props)


def sales_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """customer -placed-> order -contains-> part.  Orders and lines appear on their day."""
    c, o, p, line = (table(spark, sf_dir, n) for n in ("customer", "orders", "part", "lineitem"))
    col = F.col
    nodes = [
        _rows(c, [handle("C", "c_custkey").alias("handle")], F.lit(-1), NODE_WIDE, {"type": F.lit("customer"), "name": col("c_name"), "mktsegment": col("c_mktsegment"), "acctbal": col("c_acctbal"), "nationkey": col("c_nationkey")}),
        _rows(o, [handle("O", "o_orderkey").alias("handle")], day("o_orderdate"), NODE_WIDE, {"type": F.lit("order"), "status": col("o_orderstatus"), "totalprice": col("o_totalprice"), "priority": col("o_orderpriority")}),
        _rows(p, [handle("P", "p_partkey").alias("handle")], F.lit(-1), NODE_WIDE, {"type": F.lit("part"), "name": col("p_name"), "brand": col("p_brand"), "ptype": col("p_type"), "size": col("p_size")}),
    ]
    placed = _rows(o, [handle("p", "o_orderkey").alias("handle"), handle("C", "o_custkey").alias("src"), handle("O", "o_orderkey").alias("dst")], day("o_orderdate"), EDGE_WIDE, {"type": F.lit("placed")})
    # lines have no unique key; this handle is a label, never a join key
    label = F.concat_ws("-", F.concat(F.lit("l"), col("l_orderkey")), "l_linenumber", "l_partkey", "l_suppkey")
    contains = _rows(line, [label.alias("handle"), handle("O", "l_orderkey").alias("src"), handle("P", "l_partkey").alias("dst")], day("l_shipdate"), EDGE_WIDE, {"type": F.lit("contains"), "returnflag": col("l_returnflag"), "linestatus": col("l_linestatus"), "quantity": col("l_quantity")})
    aliases = c.select(col("c_name").alias("alias"), handle("C", "c_custkey").alias("handle"), F.lit(-1).cast("bigint").alias("created_v"), F.lit(None).cast("bigint").alias("deleted_v"))
    same = lambda wide: {k: k for k in wide}
    return Graph(Elements(nodes[0].union(nodes[1]).union(nodes[2]), None, same(NODE_WIDE)), Elements(placed.union(contains), None, same(EDGE_WIDE)), aliases, closed=True)


#: A version after all days of the tables.
NOW = 1_000_000


def user_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst) long: users whose events of a type follow one another; distinct, without loops."""
    w = Window.partitionBy("event_type").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("src"), F.lead("user_id").over(w).alias("dst"))
    return e.filter("dst is not null and src != dst").distinct()


def user_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Users as nodes, :func:`user_pairs` as edges with a weight and a confidence."""
    pairs = user_pairs(spark, sf_dir)
    always = [F.lit(-1).cast("bigint").alias("created_v"), F.lit(None).cast("bigint").alias("deleted_v")]
    users = table(spark, sf_dir, "events").select(handle("U", "user_id").alias("handle"), F.col("user_id")).distinct()
    nodes = users.select("handle", *always, F.concat(F.lit("user "), "user_id").alias("name"))
    edges = pairs.select(F.concat(F.lit("e"), "src", F.lit("-"), "dst").alias("handle"), handle("U", "src").alias("src"), handle("U", "dst").alias("dst"), *always, (1 + (F.col("src") * 7 + F.col("dst") * 13) % 20).cast("string").alias("weight"), F.round(0.05 + (F.col("src") * 3 + F.col("dst") * 5) % 19 / 20, 2).cast("string").alias("confidence"))
    return Graph(Elements(nodes, None, {"name": "name"}), Elements(edges, None, {"weight": "weight", "confidence": "confidence"}), None, closed=True)


def one(spark: SparkSession, name: str) -> DataFrame:
    """A single start node."""
    return spark.createDataFrame([(name,)], "handle string")

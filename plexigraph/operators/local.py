"""Neighbourhood analytics of all vertices in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..model import Snapshot


def two_neighborhood(snap: Snapshot, key: str, centers: DataFrame | None = None) -> DataFrame:
    """(center, node, value): nodes at the end of two hops, once each, with every value of the key.

    The first hop leaves the center; the second may come back to it.
    """
    e = snap.edges.rows.select("src", "dst").distinct()
    one = e.filter("src != dst")
    if centers is not None:
        one = one.join(centers.select(F.col("handle").alias("src")), "src", "left_semi")
    one = one.select(F.col("src").alias("center"), F.col("dst").alias("mid"))
    two = one.join(e.withColumnRenamed("src", "mid"), "mid").select("center", F.col("dst").alias("node")).distinct()
    values = snap.nodes.properties(keys=[key]).select(F.col("handle").alias("node"), "value")
    return two.join(values, "node").select("center", "node", "value")


def triangles(pairs: DataFrame) -> DataFrame:
    """(p, q, r): each triangle of an undirected simple graph once; ``pairs`` has (u, v), u < v.

    Every pair is directed from its end of lower degree.  No vertex then has more than
    sqrt(2 m) out-neighbours, so a hub does not square its degree.
    """
    degrees = pairs.select("u").union(pairs.select("v")).groupBy("u").agg(F.count("*").alias("d"))
    du, dv = degrees.select(F.col("u"), F.col("d").alias("du")), degrees.select(F.col("u").alias("v"), F.col("d").alias("dv"))
    low = F.struct("du", "u") < F.struct("dv", "v")
    directed = pairs.join(du, "u").join(dv, "v").select(F.when(low, F.col("u")).otherwise(F.col("v")).alias("p"), F.when(low, F.col("v")).otherwise(F.col("u")).alias("q"))
    left, right = directed, directed.select("p", F.col("q").alias("r"))
    wedges = left.join(right, "p").filter("q < r")
    closed = pairs.select(F.col("u").alias("q"), F.col("v").alias("r"))
    return wedges.join(closed, ["q", "r"], "left_semi").select("p", "q", "r")


def clustering(snap: Snapshot) -> DataFrame:
    """(handle, closed, k, coefficient) of every node with an out-edge.

    k counts distinct out-neighbours.  ``closed`` adds, for each out-edge c -> x, the out-edges of
    x that end in an out-neighbour of c; parallel edges count each, self-loops never.
    The coefficient is closed / (k (k - 1)), and 0 for k < 2.

    Directed multiplicities hang on the undirected pairs, whose triangles are listed once
    and then credited to each of their corners as center.
    """
    counted = snap.edges.rows.filter("src != dst").groupBy("src", "dst").agg(F.count("*").alias("n"))
    k = counted.groupBy(F.col("src").alias("handle")).agg(F.count("*").alias("k"))
    up = F.col("src") < F.col("dst")
    pairs = counted.groupBy(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).agg(F.sum(F.when(up, F.col("n")).otherwise(0)).alias("fwd"), F.sum(F.when(~up, F.col("n")).otherwise(0)).alias("bwd"))
    tri = triangles(pairs.select("u", "v"))
    for x, y in (("p", "q"), ("p", "r"), ("q", "r")):
        side = pairs.select(F.col("u").alias("su"), F.col("v").alias("sv"), "fwd", "bwd")
        tri = tri.join(side, (F.least(x, y) == side["su"]) & (F.greatest(x, y) == side["sv"]))
        forward = F.col(x) < F.col(y)
        tri = tri.select(*[c for c in tri.columns if c not in ("su", "sv", "fwd", "bwd")], F.when(forward, F.col("fwd")).otherwise(F.col("bwd")).alias(f"{x}{y}"), F.when(forward, F.col("bwd")).otherwise(F.col("fwd")).alias(f"{y}{x}"))

    def credit(c: str, x: str, y: str):
        there = lambda a, b: (F.col(f"{a}{b}") > 0).cast("long")
        return F.struct(F.col(c).alias("handle"), (F.col(f"{c}{x}") * F.col(f"{x}{y}") * there(c, y) + F.col(f"{c}{y}") * F.col(f"{y}{x}") * there(c, x)).alias("n"))

    credits = tri.select(F.explode(F.array(credit("p", "q", "r"), credit("q", "p", "r"), credit("r", "p", "q"))).alias("c")).select("c.handle", "c.n")
    closed = credits.groupBy("handle").agg(F.sum("n").alias("closed"))
    out = k.join(closed, "handle", "left").withColumn("closed", F.coalesce("closed", F.lit(0)))
    ways = F.col("k") * (F.col("k") - 1)
    return out.select("handle", "closed", "k", F.when(F.col("k") < 2, 0.0).otherwise(F.col("closed") / ways).alias("coefficient"))


def triangle_count(snap: Snapshot) -> DataFrame:
    """(n): triangles of the graph taken as undirected and simple."""
    rows = snap.edges.rows.filter("src != dst").select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v")).distinct()
    return triangles(rows).agg(F.count("*").alias("n"))

"""Graph files to graphs and back: GraphML, edge lists, tab-separated pairs, Parquet."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.scalars import parse_uint64, split_values
from ..model import TABLES, Elements, Graph


@dataclass(frozen=True)
class LoadOptions:
    """``delimiter`` splits a property's value into several; ``alias_key`` names the data that
    are aliases; ``edge_prefix`` begins generated edge handles."""

    delimiter: str | None = None
    alias_key: str | None = None
    edge_prefix: str = "e"


def _versions(df: DataFrame) -> DataFrame:
    """Loaded rows are visible from the first version on."""
    return df.withColumn("created_v", F.lit(0).cast("bigint")).withColumn("deleted_v", F.lit(None).cast("bigint"))


def _props(elements: DataFrame, options: LoadOptions) -> DataFrame:
    """(handle, data array<struct<_VALUE, _key>>) to property rows; an empty value is a value."""
    each = elements.select("handle", F.posexplode("data").alias("i", "d")).select("handle", "i", F.col("d._key").alias("key"), F.coalesce("d._VALUE", F.lit("")).alias("text"))
    each = each.select("handle", "i", "key", F.posexplode(split_values(F.col("text"), options.delimiter)).alias("j", "value"))
    each = each.dropDuplicates(["handle", "key", "value"])
    return _versions(each.select("handle", "key", "value", (F.shiftleft(F.col("i").cast("bigint"), 32) + F.col("j")).alias("ord")))


_DATA = "data ARRAY<STRUCT<_VALUE: STRING, _key: STRING>>"


def read_graphml(spark: SparkSession, path: str, options: LoadOptions = LoadOptions()) -> Graph:
    """A GraphML file, read in splits by Spark's XML source.

    A repeated node id counts once.  An edge's ends that no node element names become nodes.
    Edges without an id get the prefix and a number.
    """
    nodes = spark.read.format("xml").option("rowTag", "node").schema(f"_id STRING, {_DATA}").load(path).filter("_id is not null").select(F.col("_id").alias("handle"), "data")
    edges = spark.read.format("xml").option("rowTag", "edge").schema(f"_id STRING, _source STRING, _target STRING, {_DATA}").load(path).filter("_source is not null and _target is not null")
    named = F.coalesce("_id", F.concat(F.lit(options.edge_prefix), F.monotonically_increasing_id().cast("string")))
    edges = edges.select(named.alias("handle"), F.col("_source").alias("src"), F.col("_target").alias("dst"), "data")
    props = _props(nodes.dropDuplicates(["handle"]), options)
    aliases = None
    if options.alias_key is not None:
        aliases = _versions(props.filter(F.col("key") == options.alias_key).select(F.col("value").alias("alias"), "handle"))
        props = props.filter(F.col("key") != options.alias_key)
    every = nodes.select("handle").union(edges.select("src")).union(edges.select("dst")).distinct()
    return Graph(Elements(_versions(every), props), Elements(_versions(edges.select("handle", "src", "dst")), _props(edges, options)), aliases, closed=True)


def _from_pairs(pairs: DataFrame, props: DataFrame | None = None) -> Graph:
    """(handle, src, dst) to a graph; every end is a node."""
    nodes = pairs.select(F.col("src").alias("handle")).union(pairs.select("dst")).distinct()
    return Graph(Elements(_versions(nodes)), Elements(_versions(pairs), props), None, closed=True)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).filter(~F.col("value").startswith("#"))
    return rows.select(F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("f"))


def _numbered(prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.monotonically_increasing_id().cast("string"))


def read_snap(spark: SparkSession, path: str, options: LoadOptions = LoadOptions()) -> Graph:
    """``u v`` lines of unsigned integers; # begins a comment; lines that do not parse are skipped."""
    ends = _lines(spark, path).select(parse_uint64(F.get("f", F.lit(0))).alias("u"), parse_uint64(F.get("f", F.lit(1))).alias("v")).filter("u is not null and v is not null")
    return _from_pairs(ends.select(_numbered(options.edge_prefix).alias("handle"), F.col("u").cast("string").alias("src"), F.col("v").cast("string").alias("dst")))


def read_property_edges(spark: SparkSession, path: str, options: LoadOptions = LoadOptions()) -> Graph:
    """``u v [key value]*`` lines."""
    rows = _lines(spark, path).filter("size(f) >= 2").withColumn("handle", _numbered(options.edge_prefix))
    keys = F.filter("f", lambda _, i: (i >= 2) & (i % 2 == 0))
    values = F.filter("f", lambda _, i: (i >= 2) & (i % 2 == 1))
    # zip pads the shorter side with null: a key without a value is no property
    data = F.filter(F.zip_with(values, keys, lambda v, k: F.struct(v.alias("_VALUE"), k.alias("_key"))), lambda d: d["_VALUE"].isNotNull())
    props = _props(rows.filter("size(f) >= 4").select("handle", data.alias("data")), options)
    return _from_pairs(rows.select("handle", F.get("f", F.lit(0)).alias("src"), F.get("f", F.lit(1)).alias("dst")), props)


def read_tsv(spark: SparkSession, path: str, options: LoadOptions = LoadOptions()) -> Graph:
    """``u<tab>v`` lines of any strings."""
    rows = spark.read.schema("src STRING, dst STRING").csv(path, sep="\t", comment="#").filter("src is not null and dst is not null")
    return _from_pairs(rows.select(_numbered(options.edge_prefix).alias("handle"), "src", "dst"))


def write_graph(graph: Graph, path: str, buckets: int = 0) -> None:
    """The five tables as Parquet below ``path``; with ``buckets``, partitioned by a hash of the handle.

    A point read then adds the bucket to its filter and opens one directory.
    """
    parts = {"nodes": graph.nodes.rows, "edges": graph.edges.rows, "node_props": graph.nodes.props, "edge_props": graph.edges.props, "aliases": graph.aliases}
    for name, df in parts.items():
        if df is None:
            continue
        key = "src" if name == "edges" else "handle"
        if buckets:
            df = df.withColumn("bucket", bucket(F.col(key), buckets)).repartition("bucket").sortWithinPartitions(key)
            df.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def bucket(handle: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(handle), F.lit(buckets)).cast("int")


def read_parquet(spark: SparkSession, path: str, options: LoadOptions = LoadOptions()) -> Graph:
    """What :func:`write_graph` wrote; a table that is not there is empty."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    there = lambda p: fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs.Path(p))
    load = lambda n: spark.read.schema(TABLES[n]).parquet(f"{path}/{n}") if there(f"{path}/{n}") else spark.createDataFrame([], TABLES[n])
    return Graph(Elements(load("nodes"), load("node_props")), Elements(load("edges"), load("edge_props")), load("aliases"))


READERS: dict[str, Callable[..., Graph]] = {"graphml": read_graphml, "snap": read_snap, "property_edges": read_property_edges, "tsv": read_tsv, "parquet": read_parquet}


def load(spark: SparkSession, path: str, form: str, options: LoadOptions = LoadOptions()) -> Graph:
    """A graph file of a registered form."""
    if form not in READERS:
        raise ValueError(f"unknown graph format {form!r}; known: {', '.join(READERS)}")
    return READERS[form](spark, path, options)


def clean_edges(pairs: DataFrame) -> DataFrame:
    """(u, v) long: distinct pairs with nodes renumbered 0, 1, ... by order, without a sort in one task."""
    pairs = pairs.select(F.col("src"), F.col("dst")).distinct()
    nodes = pairs.select("src").union(pairs.select("dst")).distinct().repartitionByRange("src").sortWithinPartitions("src").withColumn("id", F.monotonically_increasing_id())
    part = F.shiftright("id", 33)
    sizes = nodes.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = {r["part"]: r["n"] for r in sizes.collect()}  # a row per task
    offsets, at = {}, 0
    for p in sorted(before):
        offsets[p], at = at, at + before[p]
    if not offsets:
        return pairs.select(F.lit(0).cast("bigint").alias("u"), F.lit(0).cast("bigint").alias("v"))
    shift = F.element_at(F.create_map(*[F.lit(x).cast("bigint") for kv in offsets.items() for x in kv]), part)
    number = nodes.select(F.col("src").alias("name"), (shift + F.col("id").bitwiseAND((1 << 33) - 1)).alias("number"))
    a, b = number.withColumnsRenamed({"name": "src", "number": "u"}), number.withColumnsRenamed({"name": "dst", "number": "v"})
    return pairs.join(a, "src").join(b, "dst").select("u", "v")


def coloured_edges(pairs: DataFrame, seed: int = 42, share: float = 0.5) -> DataFrame:
    """(value): ``u v`` lines, a ``color red`` property on about ``share`` of them."""
    red = F.when(F.pmod(F.xxhash64(F.lit(seed), "u", "v"), F.lit(1_000_000)) < int(share * 1_000_000), F.lit(" color red")).otherwise("")
    return pairs.select(F.concat(F.col("u").cast("string"), F.lit(" "), F.col("v").cast("string"), red).alias("value"))

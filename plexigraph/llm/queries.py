"""The contract-bound queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import ann, langid, linededup, mixing, packing, quality, simhash, substring, tiff, warc
from .common import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def _ready(f: Query) -> Query:
    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.pareto_mix(table(spark, sf_dir, "documents"))
    return mix.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.payload_digests(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    folder = warc.archive_folder(pages)
    back = warc.read(warc.write(pages, folder), folder)
    kind = pages.schema["page_id"].dataType
    return back.select(F.col("record_id").cast(kind).alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", F.col("refers_to").cast(kind).alias("refers_to"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.judged(table(spark, sf_dir, "documents"))
    return out.select("doc.doc_id", F.col("kept").alias("text"), "chunks", "removed")


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


QUERIES: dict[str, Query] = {
    name: _ready(f)
    for name, f in {
        "op1_pareto_mix": op1,
        "op2_simhash_pigeonhole": op2,
        "op3_length_buckets": op3,
        "op4_rank_order_langid": op4,
        "op5_pu_quality": op5,
        "op6_collinear_chaining": op6,
        "op7_tiff_pages": op7,
        "op8_warc_index": op8,
        "op9_line_chunks": op9,
        "op10_cross_polytope": op10,
    }.items()
}

ORACLES: dict[str, str] = {
    "op1_pareto_mix": mixing.ORACLE_SQL,
    "op3_length_buckets": packing.ORACLE_SQL,
    "op8_warc_index": warc.ORACLE_SQL,
    "op9_line_chunks": linededup.ORACLE_SQL,
}

"""A training-data pipeline over ``documents``, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``, with further columns of any name as they are.  Rows that repeat are
judged alike; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plexigraph.llm import linededup, mixing, packing, quality, simhash
from plexigraph.llm.common import ship, stash, table


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier rejects go; null and empty texts are scored as empty ones, null ids are never labelled."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Globally repeated multi-line chunks go from the texts; ``n_chars`` follows.

    The first occurrence stays: least id, a null one last, then place.  A null text stays null, with a null ``n_chars``.
    """
    ship(spark)
    out = linededup.dedup_lines(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: five-word shingles, a similarity of 0.8 or more.

    The least id stays, a null one last; null and empty texts are alike.
    """
    ship(spark)
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target shares: documents are drawn, or taken up to three times.

    A null source is a source; null and empty texts have size 0 and are free to take; ties go by id and md5 of the text.
    """
    ship(spark)
    return mixing.take(docs, mixing.fit_mix(docs))


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in token-budget batches of optimal length buckets; texts without words have no batch."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing sources", mix_sources),
    ("packing", pack_batches),
]

#: SQL can't express the classifier's fit or the fingerprints; tests/llm holds
#: the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Phrase search over a word graph: documents that hold consecutive words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..model import Snapshot


def parse_locations(rows: DataFrame, col: str = "locs") -> DataFrame:
    """Adds (doc, date, pos) from ``(doc, date, [p1, p2]);(...)``; what does not parse is skipped."""
    bare = F.regexp_replace(F.col(col), r"\s", "")
    each = rows.withColumn("loc", F.explode(F.regexp_extract_all(bare, F.lit(r"\((\d+,[^,]*,\[[\d,]*\])\)"), F.lit(1))))
    part = lambda p: F.regexp_extract("loc", p, 1)
    each = each.withColumn("doc", part(r"^(\d+),").try_cast("bigint")).withColumn("date", part(r"^\d+,([^,]*),"))
    return each.withColumn("pos", F.explode(F.split(part(r"\[([\d,]*)\]"), ","))).withColumn("pos", F.col("pos").try_cast("bigint")).drop("loc").filter("doc is not null and pos is not null")


def occurrences(snap: Snapshot, edge_preds=None) -> DataFrame:
    """(w1, w2, doc, date, pos) from edges ``w1,w2,i`` with a ``locs`` property."""
    edges = snap.edges.having(edge_preds).select("handle")
    rows = edges.join(snap.edges.value("locs"), "handle").withColumn("w", F.split("handle", ","))
    rows = rows.filter(F.size("w") == 3).select(F.get("w", F.lit(0)).alias("w1"), F.get("w", F.lit(1)).alias("w2"), F.col("value").alias("locs"))
    return parse_locations(rows).select("w1", "w2", "doc", "date", "pos")


def word_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(w1, w2, doc, pos): the adjacent words of each text, as such a graph's occurrences."""
    words = docs.select(F.col(id_col).alias("doc"), F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)).alias("w"))
    pairs = F.transform(F.slice("w", 2, 1 << 30), lambda x, i: F.struct(F.get("w", i).alias("w1"), x.alias("w2"), (i + 1).cast("bigint").alias("pos")))
    return words.filter(F.size("w") > 1).select("doc", F.explode(pairs).alias("p")).select("p.w1", "p.w2", "doc", "p.pos")


def phrase(found: DataFrame, words: list[str]) -> DataFrame:
    """(doc[, date]): documents in which the words follow one another.

    Step s of the phrase must stand at position p + s.  All steps are matched in one
    pass: a pair that is step s votes for (doc, pos - s), and a place with a vote for each
    step holds the phrase.  One filter that reaches the scan, one shuffle.  A single
    word matches every pair that it begins.  Dates are cut to four characters, the least wins.
    """
    dated = "date" in found.columns
    date = [F.min(F.substring("date", 1, 4)).alias("date")] if dated else []
    if len(words) < 2:
        hits = found.filter(F.col("w1") == words[0]) if words else found.limit(0)
        return hits.groupBy("doc").agg(*date) if dated else hits.select("doc").distinct()
    steps = list(zip(words, words[1:], strict=False))
    tests = [(F.col("w1") == a) & (F.col("w2") == b) for a, b in steps]
    matched = F.array_compact(F.array(*[F.when(t, F.lit(i)) for i, t in enumerate(tests)]))
    votes = found.filter(reduce(lambda x, y: x | y, tests)).withColumn("step", F.explode(matched)).withColumn("at", F.col("pos") - F.col("step"))
    places = votes.groupBy("doc", "at").agg(F.countDistinct("step").alias("n"), *date).filter(F.col("n") == len(steps))
    return places.groupBy("doc").agg(F.min("date").alias("date")) if dated else places.select("doc").distinct()

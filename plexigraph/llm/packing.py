"""Packing into optimal length buckets.

The global histogram of piece lengths (at most ``window`` numbers, whatever the
corpus) decides: dynamic programming finds the bucket boundaries that pad
least.  Inside each bucket, pieces form batches of a fixed token budget.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stash
from .mixing import words

#: Rows of one slice of a bucket; slices are ranked apart and joined by offsets.
SLICE = 10_000


def boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most ``buckets`` boundaries that minimise the total padding.

    ``histogram`` maps lengths (1 and up) to counts.  The last boundary is the
    largest length.  best[j] over the lengths so far is extended by every possible
    last bucket (i, j]: its padding is length[j] * pieces - tokens.
    """
    at = sorted(k for k, n in histogram.items() if n > 0 and k > 0)
    if not at:
        return []
    size = np.array(at, np.float64)
    n = np.array([histogram[k] for k in at], np.float64)
    pieces, tokens = np.concatenate(([0.0], np.cumsum(n))), np.concatenate(([0.0], np.cumsum(n * size)))
    m, k = len(at), min(buckets, len(at))
    best, back = np.full((k + 1, m + 1), np.inf), np.zeros((k + 1, m + 1), int)
    best[0, 0] = 0
    for b in range(1, k + 1):
        for j in range(1, m + 1):
            cost = best[b - 1, :j] + size[j - 1] * (pieces[j] - pieces[:j]) - (tokens[j] - tokens[:j])
            back[b, j] = int(np.argmin(cost))
            best[b, j] = cost[back[b, j]]
    b, j, out = int(np.argmin(best[:, m])), m, []
    while j:
        out.append(at[j - 1])
        j, b = back[b, j], b - 1
    return out[::-1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = 2048,
    buckets: int = 8,
    budget: int = 65_536,
    tokens: Column | None = None,
) -> DataFrame:
    """(id_col, piece, n_tokens, bucket_len, batch, slot, padding): a row per piece.

    A document longer than ``window`` tokens becomes pieces of ``window``
    tokens and a rest, so whole texts are packed.  ``tokens`` counts a
    document's tokens; by default its words.  A batch of the bucket with boundary b holds
    budget // b pieces (at least one).  Empty and null texts return one row of no
    tokens in no batch (nulls).  Rows that repeat are packed each.  An empty table
    returns no rows.

    Positions in a bucket are exact and contiguous without a sort of the bucket:
    the order is that of a hash, whose first digits cut the bucket into slices of about
    SLICE rows; each slice is numbered by itself, and counts of those before it are added.
    """
    count = words(F.col(text_col)) if tokens is None else F.coalesce(tokens, F.lit(0)).cast("long")
    lengths = stash(docs.select(F.col(id_col).alias("id"), count.alias("n"), F.md5(F.col(text_col)).alias("key")), "pack-lengths")
    parts = F.greatest(F.ceil(F.col("n") / window), F.lit(1)).cast("int")
    pieces = lengths.withColumn("piece", F.explode(F.sequence(F.lit(0), parts - 1)))
    pieces = pieces.withColumn("len", F.least(F.col("n") - F.col("piece") * F.lit(window).cast("long"), F.lit(window)).cast("int"))
    histogram = {r["len"]: r["c"] for r in pieces.groupBy("len").agg(F.count("*").alias("c")).collect()}
    cuts = boundaries(histogram, buckets)
    counts = [sum(c for k, c in histogram.items() if low < k <= high) for low, high in zip([0, *cuts], cuts, strict=False)]

    def by_bucket(values: list[int]) -> Column:
        out = F.lit(None).cast("long")
        for cut, v in reversed(list(zip(cuts, values, strict=True))):
            out = F.when(F.col("len") <= cut, F.lit(v).cast("long")).otherwise(out)
        return F.when(F.col("len") > 0, out)

    name = F.concat_ws("/", F.col("id").cast("string"), "key", F.col("piece").cast("string"))
    hashed = pieces.withColumn("h", F.md5(name))
    slices = by_bucket([-(-c // SLICE) for c in counts])
    nth = F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32)) * slices)
    cut = hashed.withColumn("bucket_len", by_bucket(cuts)).withColumn("rows", by_bucket([max(1, budget // c) for c in cuts])).withColumn("slice", nth)
    sizes = cut.filter("len > 0").groupBy("bucket_len", "slice").agg(F.count("*").alias("c"))
    offset = F.coalesce(F.sum("c").over(Window.partitionBy("bucket_len").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("bucket_len", "slice", offset.alias("offset"))
    order = Window.partitionBy("bucket_len", "slice").orderBy("h", "id", "key", "piece")
    ranked = cut.filter("len > 0").withColumn("nth", F.row_number().over(order) - 1).join(offsets, ["bucket_len", "slice"])
    at = F.col("offset") + F.col("nth")
    packed = ranked.select(
        F.col("id").alias(id_col), "piece", F.col("len").alias("n_tokens"), "bucket_len", F.floor(at / F.col("rows")).alias("batch"), F.pmod(at, F.col("rows")).alias("slot"), (F.col("bucket_len") - F.col("len")).alias("padding")
    )
    none = F.lit(None).cast("long")
    empty = pieces.filter("len = 0").select(F.col("id").alias(id_col), "piece", F.col("len").alias("n_tokens"), none.alias("bucket_len"), none.alias("batch"), none.alias("slot"), F.lit(0).cast("long").alias("padding"))
    return packed.unionByName(empty)


#: The result of op3 in DuckDB's SQL: the boundaries by a recursive query over the histogram.
ORACLE_SQL = r"""
WITH RECURSIVE lens AS (
  SELECT doc_id, md5(text) AS key, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS n FROM documents),
parts AS (
  SELECT doc_id, key, n, CAST(unnest(range(0, greatest(CAST(ceil(n / 2048.0) AS BIGINT), 1))) AS INTEGER) AS piece FROM lens),
pieces AS (
  SELECT doc_id, key, piece, CAST(least(n - piece * 2048, 2048) AS INTEGER) AS len FROM parts),
hist AS (
  SELECT len, count(*) AS c, row_number() OVER (ORDER BY len) AS j FROM pieces WHERE len > 0 GROUP BY len),
pre AS (
  SELECT j, len, CAST(sum(c) OVER (ORDER BY j) AS BIGINT) AS p, CAST(sum(c * len) OVER (ORDER BY j) AS BIGINT) AS t FROM hist),
dp(k, j, p, t, cost, cuts) AS (
  SELECT 1, j, p, t, len * p - t, [len] FROM pre
  UNION ALL
  SELECT a.k + 1, b.j, b.p, b.t, min(a.cost + b.len * (b.p - a.p) - (b.t - a.t)),
         arg_min(list_append(a.cuts, b.len), (a.cost + b.len * (b.p - a.p) - (b.t - a.t)) * 4096 + a.j)
  FROM dp a JOIN pre b ON b.j > a.j WHERE a.k < 8 GROUP BY a.k + 1, b.j, b.p, b.t),
best AS (
  SELECT cuts FROM dp WHERE j = (SELECT max(j) FROM pre) ORDER BY cost, k LIMIT 1),
cut AS (
  SELECT doc_id, key, piece, len, (SELECT list_min(list_filter(cuts, lambda c: c >= len)) FROM best) AS bucket_len FROM pieces),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY len > 0, bucket_len ORDER BY md5(concat_ws('/', CAST(doc_id AS VARCHAR), key, CAST(piece AS VARCHAR))), doc_id, key, piece) - 1 AS nth,
         greatest(1, 65536 // bucket_len) AS room FROM cut)
SELECT doc_id, piece, len AS n_tokens, CASE WHEN len > 0 THEN CAST(bucket_len AS BIGINT) END AS bucket_len,
       CASE WHEN len > 0 THEN nth // room END AS batch, CASE WHEN len > 0 THEN nth % room END AS slot,
       CASE WHEN len > 0 THEN CAST(bucket_len - len AS BIGINT) ELSE 0 END AS padding
FROM placed
"""

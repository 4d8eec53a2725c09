"""Line dedup: content-defined chunks of lines, removed where they repeat.

DataFrame operations only.  A polynomial rolling hash over the hashes of the last
WINDOW lines ends a chunk where it is divisible by ``every``, so boundaries depend on
nearby lines alone and an inserted line shifts no boundary beyond the next.
Chunks of two or more lines are counted over the whole corpus by a 64-bit hash;
of those whose hash repeats, the bytes are compared, and all but the first
occurrence (least document id, a null one last, then position) are removed.
Each match is then extended line by line, before its start and beyond its end, as long as
the lines (by their md5) equal those around the first occurrence: a repeated block rarely
begins and ends at boundaries.  A match looks REACH lines to each side; longer blocks hold
further chunks.  A removed line always equals one at an earlier place, so one copy stays.

The text is only moved where a chunk may repeat: counting shuffles hashes,
and the two tables that decide (repeated hashes; chunks to remove) are
broadcast while a count shows that they are small, and shuffled beyond that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from .common import Stash, stash

#: Lines under the rolling hash, its base and its modulus.
WINDOW, BASE, MODULUS = 2, 31, 1_000_003
#: Lines around a chunk that a match may take in, on each side.
REACH = 16
#: Rows up to which a deciding table is broadcast (at most some 100 bytes each).
SMALL = 200_000


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with value computed once, not once per element of a lambda."""
    return F.element_at(F.transform(F.array(value), then), 1)


def chunk(text: Column, every: int, reach: int = 0) -> Column:
    """array<struct<start int, n int, body string>>: the chunks of a text, in order, and the line each starts at.

    With ``reach``, also ``before`` and ``after``: the md5 of so many lines around it, nearest first.
    """

    def cut(lines: Column) -> Column:
        return let(F.transform(lines, F.md5), lambda m: hashed(lines, m))

    def hashed(lines: Column, m: Column) -> Column:
        return let(F.transform(m, lambda x: F.conv(F.substring(x, 1, 7), 16, 10).cast("long")), lambda h: ends(lines, m, h))

    def ends(lines: Column, m: Column, h: Column) -> Column:
        before = lambda i, k: F.coalesce(F.get(h, i - 1 - k), F.lit(0))
        rolled = lambda i: F.pmod(sum((before(i, k) * BASE ** (WINDOW - 1 - k) for k in range(1, WINDOW)), before(i, 0) * BASE ** (WINDOW - 1)), F.lit(MODULUS))
        last = lambda i: (i == F.size(lines)) | (rolled(i) % every == 0)
        return let(F.filter(F.sequence(F.lit(1), F.size(lines)), last), lambda e: bodies(lines, m, e))

    def bodies(lines: Column, m: Column, e: Column) -> Column:
        def body(end: Column, j: Column) -> Column:
            start = F.coalesce(F.get(e, j - 1), F.lit(0))
            own = [start.alias("start"), (end - start).alias("n"), F.array_join(F.slice(lines, start + 1, end - start), "\n").alias("body")]
            if reach:
                first = F.greatest(start - reach, F.lit(0))
                own += [F.reverse(F.slice(m, first + 1, start - first)).alias("before"), F.slice(m, end + 1, F.lit(reach)).alias("after")]
            return F.struct(*own)

        return F.transform(e, body)

    return let(F.split(text, "\n"), cut)


def _common(a: Column, b: Column) -> Column:
    """How many elements two arrays begin with alike."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    differ = F.array_position(same, F.lit(False))
    return F.when(differ == 0, F.size(same)).otherwise(differ - 1).cast("int")


def _small(df: DataFrame, items: Column | None = None) -> DataFrame:
    """Broadcast if counts show at most SMALL rows, and of the items in their arrays eight times as many; else as it is."""
    rows, n = df.agg(F.count("*"), F.coalesce(F.sum(F.lit(0) if items is None else items), F.lit(0))).first()
    return F.broadcast(df) if rows <= SMALL and n <= 8 * SMALL else df


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 2) -> DataFrame:
    """(id, key, removed array<int>): for each document, the lines to remove, from 0.

    ``key`` is md5 of the text: (id, key) names a document, and rows equal in
    both are one document.  Null texts have no chunks; chunks of one line or of white
    space alone never count as repeated, but may go as lines next to one that does.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text like '%\\n%'")

    def hashed(reach: int) -> DataFrame:
        each = base.select("id", F.md5("text").alias("key"), F.explode(chunk(F.col("text"), every, reach)).alias("c")).select("id", "key", "c.*")
        return each.filter((F.col("n") > 1) & F.col("body").rlike(r"[^\x20\x09-\x0D]")).withColumn("h", F.xxhash64("body"))

    twice = Stash(hashed(0).groupBy("h").agg(F.count("*").alias("c")).filter("c > 1").select("h"), "lines-twice")
    candidates = Stash(hashed(REACH).join(_small(twice.df), "h", "left_semi"), "lines-candidates")
    place = [F.col("id").isNull().alias("none"), F.col("id"), F.col("key"), F.col("start")]
    # written first, so that the join has plain exchanges on both sides and a hot chunk can be split
    first = Stash(candidates.df.groupBy("h", "body").agg(F.min(F.struct(*place, "before", "after")).alias("first")), "lines-first")
    there = F.struct(*[F.col(f"first.{c}") for c in ("none", "id", "key", "start")])
    later = candidates.df.join(first.df, ["h", "body"]).filter(~F.struct(*place).eqNullSafe(there))
    start = F.col("start") - _common(F.col("before"), F.col("first.before"))
    end = F.col("start") + F.col("n") + _common(F.col("after"), F.col("first.after"))
    gone = later.select("id", "key", F.sequence(start, end - 1).alias("lines"))
    removed = stash(gone.groupBy("id", "key").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("removed")), "lines-removed")
    for done in (candidates, twice, first):
        done.drop()
    return removed


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 2) -> DataFrame:
    """(doc struct, kept, chunks, removed): each row of ``docs``, the text that stays, how many chunks there were and how many lines went.

    The order of the remaining lines is kept; a text whose lines all go becomes empty, a null text stays null and has no
    chunks.  Rows equal in id and text are one document, and both are changed alike.  An empty table gives no rows.
    """
    gone = repeated_lines(docs, id_col, text_col, every)
    held = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own_id"), F.col(text_col).alias("own_text"))
    joined = held.join(_small(gone, F.size("removed")), F.col("own_id").eqNullSafe(F.col("id")) & (F.md5("own_text") == F.col("key")), "left")
    stay = lambda lines: F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("removed"))
    kept = let(F.split(F.col("own_text"), "\n"), lambda lines: F.array_join(F.transform(stay(lines), lambda i: F.get(lines, i)), "\n"))
    return joined.select("doc", F.when(F.col("removed").isNull(), F.col("own_text")).otherwise(kept).alias("kept"), F.coalesce(F.size(chunk(F.col("own_text"), every)), F.lit(0)).alias("chunks"), F.coalesce(F.size("removed"), F.lit(0)).alias("removed"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 2) -> DataFrame:
    """``docs``, all columns of any name, with the repeated lines gone from the text: see :func:`judged`."""
    out = judged(docs, id_col, text_col, every)
    return out.select(*[F.col("kept").alias(c) if c == text_col else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


#: The result of op9 in DuckDB's SQL.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, text, md5(text) AS key, string_split(text, chr(10)) AS lines FROM documents),
m AS (
  SELECT *, list_transform(lines, lambda x: md5(x)) AS m FROM (SELECT DISTINCT * FROM l WHERE text IS NOT NULL)),
h AS (
  SELECT *, list_transform(m, lambda x: CAST('0x' || substr(x, 1, 7) AS BIGINT)) AS h FROM m),
e AS (
  SELECT *, list_filter(range(1, len(lines) + 1), lambda i: i = len(lines) OR
    ((h[i] * 31 + (CASE WHEN i > 1 THEN h[i - 1] ELSE 0 END)) % 1000003) % 2 = 0) AS ends
  FROM h),
c AS (
  SELECT doc_id, key, m, ends, lines, unnest(range(1, len(ends) + 1)) AS j FROM e),
p AS (
  SELECT *, CASE WHEN j > 1 THEN ends[j - 1] ELSE 0 END AS s, ends[j] AS t FROM c),
b AS (
  SELECT doc_id, key, s, t, array_to_string(lines[s + 1 : t], chr(10)) AS body,
         list_reverse(m[greatest(s - 16, 0) + 1 : s]) AS before, m[t + 1 : t + 16] AS after
  FROM p),
f AS (
  SELECT *, row_number() OVER w AS r, first_value(before) OVER w AS before1, first_value(after) OVER w AS after1
  FROM b WHERE t - s > 1 AND regexp_matches(body, '[^\x20\x09-\x0D]')
  WINDOW w AS (PARTITION BY body ORDER BY doc_id NULLS LAST, key, s)),
g AS (
  SELECT doc_id, key, unnest(range(
    s - len(list_filter(range(1, least(len(before), len(before1)) + 1), lambda i: before[1 : i] = before1[1 : i])),
    t + len(list_filter(range(1, least(len(after), len(after1)) + 1), lambda i: after[1 : i] = after1[1 : i])))) AS line
  FROM f WHERE r > 1),
r AS (
  SELECT doc_id, key, list(DISTINCT line) AS gone FROM g GROUP BY doc_id, key)
SELECT d.doc_id, CASE WHEN r.gone IS NULL THEN d.text ELSE array_to_string(list_transform(list_filter(range(0, len(d.lines)), lambda i: NOT list_contains(r.gone, i)), lambda i: d.lines[i + 1]), chr(10)) END AS text,
       CAST(coalesce(len(e.ends), 0) AS INTEGER) AS chunks, CAST(coalesce(len(r.gone), 0) AS INTEGER) AS removed
FROM l d LEFT JOIN e ON d.doc_id IS NOT DISTINCT FROM e.doc_id AND d.key = e.key
LEFT JOIN r ON d.doc_id IS NOT DISTINCT FROM r.doc_id AND d.key = r.key
"""

"""Mixing sources to target weights by Pareto order sampling.

DataFrame operations only.  A document is expected in the mix ``rate * weight`` times,
MOST times at most, with a rate for each source that makes the expected words its target.  Unless weights are
given, they grow with the logarithm of a document's size: longer documents are likelier.
The whole part of the expected number is certain; the rest is an inclusion probability
``lam``.  Documents are ranked by Rosen's Pareto order statistic

    q = (u / (1 - u)) / (lam / (1 - lam))

where u is a uniform number that md5 derives from the document, and the mix
takes the front of each source's ranking, up to the words the target still
needs: a sample of fixed size in words, of unequal probabilities.  At most one more
document, whose size comes closest to what is still missing, closes the gap.

No ranking is ever sorted as a whole.  Sums of words by ranking bucket (two
levels of 1024 buckets, combined before the shuffle) find the bucket where the
target is reached, and only that bucket's rows, about a millionth of the source,
meet in one window.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import stash

#: Words, as the contracts define them.
WORD = r"[^\x20\x09-\x0D]+"
#: Buckets of each of the two levels.
FINE = 1024
#: No document is taken more often.
MOST = 3
#: Sources up to which the tables of a row per source are broadcast.
SMALL = 100_000


def words(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1, the same on every run and every engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}/"), key)), 1, 13)
    return (F.conv(digits, 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def water_fill(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (source, size long, weight long): shares of the sum of sizes.

    A source's target stops at MOST times its size; the excess goes to the others by
    weight until none is above.  With the sources in order of cap / weight,
    those stopped are the first k, where k is the least for which the next
    source's cap / weight is above the level that the others then share, so that one
    pass over the (few) sources replaces the repetition.
    """
    by = Window.orderBy(F.col("size") * MOST / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("size").over(Window.partitionBy())
    level = (total - MOST * F.coalesce(F.sum("size").over(before), F.lit(0))) / F.sum("weight").over(rest)
    open_ = F.col("weight") * F.col("level") <= F.col("size") * MOST
    leveled = sources.withColumn("level", level)
    # the first source that is not stopped sets the level for all from there on
    first = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return leveled.withColumn("at", first).withColumn("target", F.when(F.col("at").isNull(), (F.col("size") * MOST).cast("double")).otherwise(F.col("weight") * F.col("at"))).drop("level", "at")


def size_weight(size: Column) -> Column:
    """8 more than the number of binary digits."""
    return F.length(F.bin(size)) + 8


def _given_weight(weight: Column) -> Column:
    """Null and negative weights as zero; the others rounded to 64 steps a doubling, so that their distinct values are few."""
    w = F.greatest(F.coalesce(weight.cast("double"), F.lit(0.0)), F.lit(0.0))
    return F.when(w > 0, F.pow(F.lit(2.0), F.round(F.log2(w) * 64) / 64)).otherwise(0.0)


def rates(slim: DataFrame, targets: DataFrame) -> DataFrame:
    """(s, source_size, target, rate): the expected copies of weight 1 in each source; null: all MOST times.

    Of a source's weights, in falling order, the first k are held at MOST copies, where k is the least
    for which the rate that the others then need keeps them below it.  Windows see a row per source and weight.
    """
    sums = slim.filter("w > 0").groupBy("source", "w").agg(F.sum("size").alias("n"))
    by = Window.partitionBy("source").orderBy(F.col("w").desc())
    held = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum(F.col("w") * F.col("n")).over(by.rowsBetween(0, Window.unboundedFollowing))
    each = sums.join(_few(targets), F.col("source").eqNullSafe(F.col("s"))).withColumn("rest", rest).withColumn("held", held)
    each = each.withColumn("rate", F.when(F.col("rest") > 0, (F.col("target") - MOST * F.col("held")) / F.col("rest")))
    fits = F.col("rate") * F.col("w") <= MOST
    found = each.groupBy("s").agg(F.max_by("rate", F.when(fits, F.col("w"))).alias("rate"))
    return targets.join(found.withColumnRenamed("s", "s_"), F.col("s").eqNullSafe(F.col("s_")), "left").drop("s_")


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, weight_col: str | None, seed: int, *more: Column) -> DataFrame:
    """(id, key, source, size, w, u) of every document, and ``more``."""
    given = F.lit(None).cast("double") if weight_col is None else _given_weight(F.col(weight_col))
    rows = docs.select(F.col(id_col).alias("id"), F.md5(F.col(text_col)).alias("key"), F.col(source_col).alias("source"), words(F.col(text_col)).alias("size"), given.alias("w"), *more)
    if weight_col is None:
        rows = rows.withColumn("w", size_weight(F.col("size")))
    key = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit("/"), F.coalesce("key", F.lit("")))
    return rows.withColumn("u", uniform(key, seed))


def _few(df: DataFrame) -> DataFrame:
    """A table of a row per source: broadcast if a count shows that it is small."""
    return F.broadcast(df) if df.count() <= SMALL else df


def _score(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Adds copies expected, their whole part, the inclusion probability and the place in the ranking."""
    expected = F.when(F.col("w") > 0, F.least(F.coalesce(F.col("rate") * F.col("w"), F.lit(float(MOST))), F.lit(float(MOST)))).otherwise(0.0)
    q = (F.col("u") / (1 - F.col("u"))) / (F.col("lam") / (1 - F.col("lam")))
    return (
        rows.join(sources, F.col("source").eqNullSafe(F.col("s")))
        .withColumn("expected", expected)
        .withColumn("base", F.floor("expected"))
        .withColumn("lam", F.col("expected") - F.col("base"))
        .withColumn("p", F.when(F.col("lam") > 0, q / (1 + q)))
        .withColumn("b", F.least(F.floor(F.col("p") * (FINE * FINE)), F.lit(FINE * FINE - 1)))
        .withColumn("rank", F.struct("p", "id", "key", "size"))
    )


@dataclass(frozen=True)
class Mix:
    """What decides about a document: a row per source in each table, and the columns read."""

    slim: DataFrame
    sources: DataFrame  # s, source_size, target, rate
    ends: DataFrame  # s, b: the bucket in which the target is reached, and the last rank taken in it; gap
    closers: DataFrame  # s, close: the rank of the closing document
    columns: tuple[str, str, str, str | None, int]

    def decide(self, rows: DataFrame) -> DataFrame:
        """Adds ``copies`` to rows that :func:`_slim` made."""
        d = _score(rows, _few(self.sources))
        taken = F.coalesce((F.col("b") < F.col("b3")) | ((F.col("b") == F.col("b3")) & (F.col("rank") <= F.col("upto"))), F.lit(False))
        # a source whose need is never reached takes all that may be taken
        pick = F.when(F.col("p").isNull(), False).when(F.col("b3").isNull(), True).otherwise(taken)
        marked = d.join(_few(self.ends), F.col("s").eqNullSafe(F.col("s3")), "left").withColumn("pick", pick)
        full = marked.join(_few(self.closers), F.col("s").eqNullSafe(F.col("s4")), "left").withColumn("pick", F.col("pick") | F.coalesce(F.col("rank") == F.col("close"), F.lit(False)))
        return full.withColumn("copies", (F.col("base") + F.col("pick").cast("long")).cast("int"))


def fit_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    weight_col: str | None = None,
    seed: int = 42,
) -> Mix:
    """Targets and thresholds for a corpus.

    Sources in code point order, null last, weigh ``weights``, repeating.
    ``weight_col`` takes the place of the weights by size; null and
    negative weights count as zero.  Documents of equal id and text, which no
    rule can tell apart, are taken or left together.  Null texts have size 0 and
    are free to take.
    """
    columns = (id_col, text_col, source_col, weight_col, seed)
    slim = stash(_slim(docs, *columns), "mix-slim")
    sums = slim.groupBy("source").agg(F.sum("size").alias("size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    share = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(nth, F.lit(len(weights))) + 1).cast("int")).cast("long")
    targets = stash(water_fill(sums.withColumn("weight", share)).select(F.col("source").alias("s"), F.col("size").alias("source_size"), "target"), "mix-targets")
    sources = stash(rates(slim, targets), "mix-sources")
    d = _score(slim, _few(sources))
    need = d.groupBy("s").agg((F.first("target") - F.sum(F.col("base") * F.col("size"))).alias("need"))
    drawn = d.filter("p is not null")

    def crossing(sizes: DataFrame, bucket: str, start: DataFrame) -> DataFrame:
        """(s, bucket, need): the bucket in which a source's need ends, and what of it is then left."""
        run = Window.partitionBy("s").orderBy(bucket)
        cum = sizes.withColumn("upto", F.sum("n").over(run.rowsBetween(Window.unboundedPreceding, 0)))
        j = cum.withColumnRenamed("s", "s_").join(start, F.col("s_").eqNullSafe(F.col("s"))).filter("upto > need and upto - n <= need")
        return j.select("s", bucket, (F.col("need") - F.col("upto") + F.col("n")).alias("need"))

    coarse = F.floor(F.col("b") / FINE).alias("c")
    level1 = crossing(drawn.groupBy("s", coarse).agg(F.sum("size").alias("n")), "c", need)
    at1 = level1.select(F.col("s").alias("s1"), F.col("c").alias("c1"), F.col("need").alias("need1"))
    in1 = drawn.join(at1, F.col("s").eqNullSafe(F.col("s1")) & (F.floor(F.col("b") / FINE) == F.col("c1")))
    start2 = level1.select("s", "need")
    at2 = stash(crossing(in1.groupBy("s", "b").agg(F.sum("size").alias("n")), "b", start2).select(F.col("s").alias("s2"), F.col("b").alias("b2"), F.col("need").alias("need2")), "mix-at")
    # the rows of the last bucket, equal ones together
    last = drawn.join(_few(at2), F.col("s").eqNullSafe(F.col("s2")) & (F.col("b") == F.col("b2"))).groupBy("s2", "b2", "need2", "rank").agg(F.sum("size").alias("n"))
    front = last.withColumn("upto", F.sum("n").over(Window.partitionBy("s2").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))).withColumn("in", F.col("upto") <= F.col("need2"))
    ends = front.groupBy("s2", "b2").agg(F.max(F.when(F.col("in"), F.col("rank"))).alias("upto"), (F.first("need2") - F.coalesce(F.max(F.when(F.col("in"), F.col("upto"))), F.lit(0))).alias("gap"))
    ends = stash(ends.select(F.col("s2").alias("s3"), F.col("b2").alias("b3"), "upto", "gap"), "mix-ends")
    none = ends.limit(0).select(F.col("s3").alias("s4"), F.col("upto").alias("close"))
    marked = Mix(slim, sources, ends, none, columns).decide(slim).filter("p is not null and not pick and size > 0")
    off = F.abs(F.col("size") - F.col("gap"))
    closing = marked.filter(off < F.col("gap")).groupBy("s3").agg(F.min(F.struct(off.alias("off"), "rank")).alias("least"))
    closing = closing.select(F.col("s3").alias("s4"), F.col("least.rank").alias("close"))
    # of a closing document that is there more than once, all rows would come: only if that too comes nearer
    rows = drawn.join(closing, F.col("s").eqNullSafe(F.col("s4")) & (F.col("rank") == F.col("close"))).groupBy("s4", "close").agg(F.sum("size").alias("n"))
    rows = rows.join(_few(ends), F.col("s4").eqNullSafe(F.col("s3"))).filter(F.abs(F.col("n") - F.col("gap")) < F.col("gap")).select("s4", "close")
    return Mix(slim, sources, ends, stash(rows, "mix-close"), columns)


def pareto_mix(docs: DataFrame, **options) -> DataFrame:
    """(id, key, source, size, source_size, target, copies), one row per document.

    ``key`` is md5 of the text (null for null), so that (id, key) finds the document again.
    Options are those of :func:`fit_mix`.  An empty table gives no rows.
    """
    mix = fit_mix(docs, **options)
    return mix.decide(mix.slim).select("id", "key", "source", "size", "source_size", "target", "copies")


def take(docs: DataFrame, mix: Mix) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of ``docs``.

    Every row decides for itself from its source's thresholds, so no text is shuffled.
    """
    rows = mix.decide(_slim(docs, *mix.columns, F.struct("*").alias("doc")))
    each = rows.filter("copies > 0").withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return each.select("doc.*")


#: The result of op1 in DuckDB's SQL: the same ranking as one window per source.
ORACLE_SQL = r"""
WITH slim AS (
  SELECT doc_id AS id, md5(text) AS key, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
u AS (
  SELECT *, (CAST(CAST('0x' || substr(md5('42/' || coalesce(CAST(id AS VARCHAR), '') || '/' || coalesce(key, '')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5)
            / 4503599627370496.0 AS u FROM slim),
src AS (
  SELECT source AS s, CAST(sum(size) AS BIGINT) AS size,
         1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight
  FROM slim GROUP BY source),
lev AS (
  SELECT *, (sum(size) OVER () - 3 * coalesce(sum(size) OVER (ORDER BY size * 3 / weight, s NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER (ORDER BY size * 3 / weight, s NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM src),
lev2 AS (
  SELECT *, first_value(CASE WHEN weight * level <= size * 3 THEN level END IGNORE NULLS)
            OVER (ORDER BY size * 3 / weight, s NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS lv
  FROM lev),
tgt AS (SELECT s, size AS source_size, CASE WHEN lv IS NULL THEN CAST(size * 3 AS DOUBLE) ELSE weight * lv END AS target FROM lev2),
wts AS (SELECT *, length(bin(size)) + 8 AS w FROM u),
cls AS (
  SELECT s, target, w, n, coalesce(sum(n) OVER (PARTITION BY s ORDER BY w DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
         sum(w * n) OVER (PARTITION BY s ORDER BY w DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM (SELECT source, w, CAST(sum(size) AS BIGINT) AS n FROM wts GROUP BY ALL) JOIN tgt ON source IS NOT DISTINCT FROM s),
lam AS (SELECT *, CASE WHEN rest > 0 THEN (target - 3 * CAST(held AS BIGINT)) / CAST(rest AS DOUBLE) END AS rate FROM cls),
rat AS (SELECT s, arg_max(rate, w) FILTER (rate * w <= 3) AS rate FROM lam GROUP BY s),
d AS (
  SELECT wts.*, source_size, target, least(coalesce(rate * w, 3.0), 3.0) AS copies
  FROM wts JOIN tgt ON wts.source IS NOT DISTINCT FROM tgt.s JOIN rat ON wts.source IS NOT DISTINCT FROM rat.s),
e AS (SELECT *, floor(copies) AS base, copies - floor(copies) AS lam FROM d),
q AS (SELECT *, CASE WHEN lam > 0 THEN (u / (1 - u)) / (lam / (1 - lam)) END AS q FROM e),
r AS (
  SELECT *, q / (1 + q) AS p,
         target - sum(CAST(base AS BIGINT) * size) OVER (PARTITION BY source) AS need FROM q),
c AS (
  SELECT *, CASE WHEN p IS NOT NULL THEN sum(size) OVER (PARTITION BY source, p IS NULL ORDER BY p, id, key, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS upto
  FROM r),
g AS (
  SELECT *, coalesce(upto <= need, false) AS pick,
         need - coalesce(max(CASE WHEN upto <= need THEN upto END) OVER (PARTITION BY source), 0) AS gap,
         sum(size) OVER (PARTITION BY source, p, id, key, size) AS n FROM c),
h AS (
  SELECT *, CASE WHEN p IS NOT NULL AND NOT pick AND size > 0 AND abs(size - gap) < gap
                 THEN row_number() OVER (PARTITION BY source, p IS NOT NULL AND NOT pick AND size > 0 AND abs(size - gap) < gap ORDER BY abs(size - gap), p, id, key, size) END AS nth
  FROM g),
f AS (
  SELECT *, first_value(CASE WHEN nth = 1 THEN p END IGNORE NULLS) OVER w AS cp, first_value(CASE WHEN nth = 1 THEN id END IGNORE NULLS) OVER w AS cid
  FROM h WINDOW w AS (PARTITION BY source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT id AS doc_id, size, source_size, target,
       CAST((CAST(base AS BIGINT) + CASE WHEN pick OR (nth IS NOT NULL AND p = cp AND id IS NOT DISTINCT FROM cid AND abs(n - gap) < gap) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM f
"""

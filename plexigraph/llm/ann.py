"""Approximate nearest neighbours by cross-polytope hashing.

A unit vector is rotated by H D H D H D (D: random signs, H: the fast Hadamard
transform) and assigned to the nearest signed axis.  Each of TABLES tables
concatenates several such hashes, the last of them over fewer axes, so that a bucket
holds about OCCUPANCY vectors at any size of the table.  A query probes the buckets of
the best axis combinations; their number grows about as the root of the number of buckets, so the share of
the table that a query sees falls as the table grows.  Equal vectors are one
class, so that a vector of which there are many costs one row.  Buckets are verified in
blocks of bounded size and each block returns only a query's best, scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import Stash, column, stash

#: Tables, and the vectors that a bucket should hold.
TABLES, OCCUPANCY = 12, 128
#: Probes in each table: so many of 512 buckets, growing by this power of the number of buckets.
#: Measured recall of the five nearest and share of the table seen, on independent normal vectors
#: of 64 dimensions (the hardest case) or nearly so: 0.995 and 0.62 of 2,000, 0.98 and 0.40 of 51,282,
#: 0.987 and 0.20 of 600,000.
PROBES, GROWTH = 20, 0.54
#: Index vectors in one block.
BLOCK = 4096
#: Pairs scored exactly at a time.
PAIRS = 1 << 16
#: Rows up to which a table is broadcast.
SMALL = 50_000


def hadamard(x: np.ndarray) -> np.ndarray:
    """The unnormalised Walsh-Hadamard transform of each row, in n log n."""
    rows, d = x.shape
    h = 1
    while h < d:
        y = x.reshape(rows, d // (2 * h), 2, h)
        x = np.stack((y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]), axis=2).reshape(rows, d)
        h *= 2
    return x


def rotate(x: np.ndarray, table: int, part: int, seed: int) -> np.ndarray:
    """The pseudo-rotation of unit rows, padded to a power of two."""
    d = 1 << max(1, math.ceil(math.log2(x.shape[1])))
    y = np.pad(x, ((0, 0), (0, d - x.shape[1])))
    signs = np.random.default_rng([seed, table, part]).integers(0, 2, (3, d)) * 2 - 1
    for s in signs:
        y = hadamard(y * s) / math.sqrt(d)
    return y


def shape_of(n: int, d: int) -> tuple[int, ...]:
    """The numbers of axes of the hashes of a table over n vectors of d dimensions.

    Each hash has all axes but the last, which has so few that about OCCUPANCY vectors share a bucket.
    """
    wide = 1 << max(1, math.ceil(math.log2(d)))
    bits, each = round(math.log2(max(n / OCCUPANCY, 1.0))), int(math.log2(2 * wide))
    whole, rest = divmod(max(bits, each), each)
    return (wide,) * whole + ((1 << (rest - 1),) if rest else ())


def probes_of(axes: tuple[int, ...]) -> int:
    """Probes in each table."""
    return math.ceil(PROBES * (math.prod(2 * a for a in axes) / 512) ** GROWTH)


def buckets(x: np.ndarray, table: int, axes: tuple[int, ...], probes: int, seed: int) -> np.ndarray:
    """(rows, probes) bucket numbers of unit rows, best first.

    A probe takes one signed axis per hash; combinations are ordered by the sum over
    the hashes of how far an axis lies behind the hash's best one.  The best of all hashes begin
    with one of the best of the first few, so no more than ``probes`` are kept at each.
    """
    code, loss, scale = np.zeros((len(x), 1), np.int64), np.zeros((len(x), 1)), 1
    for part, d in enumerate(axes):
        y = rotate(x, table, part, seed)[:, :d]
        both = np.concatenate((y, -y), axis=1)
        few = min(probes, 2 * d)
        top = np.argsort(-both, axis=1, kind="stable")[:, :few]
        value = np.take_along_axis(both, top, axis=1)
        behind = (loss[:, :, None] + (value[:, :1] - value)[:, None, :]).reshape(len(x), -1)
        every = (code[:, :, None] + top[:, None, :] * scale).reshape(len(x), -1)
        order = np.argsort(behind, axis=1, kind="stable")[:, :probes]
        code, loss = np.take_along_axis(every, order, axis=1), np.take_along_axis(behind, order, axis=1)
        scale *= 2 * d
    return code


def _matrix(batch: pa.RecordBatch, name: str = "v") -> np.ndarray:
    col = column(batch, name)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(batch.num_rows, -1) if batch.num_rows else flat.reshape(0, 1)


def _tame(x: np.ndarray) -> np.ndarray:
    """Rows whose squares overflow or vanish, scaled by their largest component; the others as they are."""
    with np.errstate(over="ignore"):
        n = (x * x).sum(axis=1)
    odd = ~np.isfinite(n) | (n < 1e-200)
    if odd.any():
        x = x.copy()
        x[odd] /= np.abs(x[odd]).max(axis=1, keepdims=True)
    return x


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one."""
    x = _tame(x)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision, summed the same way wherever it is called."""
    a, b = _tame(a), _tame(b)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _hashed(rows: DataFrame, axes: tuple[int, ...], probes: int, seed: int) -> DataFrame:
    """(c, v) to (t, b, c, v): a row per table and probe."""
    step = max(1, min(1024, (1 << 22) // (probes * 2 * max(axes))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, step):
                b = whole.slice(at, step)
                x = _unit(_matrix(b))
                for t in range(TABLES):
                    code = buckets(x, t, axes, probes, seed)
                    for p in range(code.shape[1]):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t, np.int32)), pa.array(code[:, p]), column(b, "c"), column(b, "v")], ["t", "b", "c", "v"])

    kind, v = (rows.schema[x].dataType.simpleString() for x in ("c", "v"))
    return rows.select("c", "v").mapInArrow(run, f"t int, b long, c {kind}, v {v}")


def _search(most: int):
    """Rows sorted by block, index rows (role 0) before queries (role 1): each query's best of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, vectors, packed = None, [], [], None
        for whole in batches:
            if not whole.num_rows:
                continue
            cols = [column(whole, c).to_numpy(zero_copy_only=False) for c in ("t", "b", "blk", "role")]
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            bounds = [0, *new.tolist(), whole.num_rows]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                key, role = tuple(int(c[lo]) for c in cols[:3]), int(cols[3][lo])
                if key != now:
                    now, ids, vectors, packed = key, [], [], None
                part = whole.slice(lo, hi - lo)
                if role == 0:
                    ids.append(column(part, "c").to_numpy(zero_copy_only=False))
                    vectors.append(_matrix(part))
                    continue
                if not ids:
                    continue
                if packed is None:
                    packed = np.concatenate(ids), np.concatenate(vectors)
                    packed = (*packed, _unit(packed[1]))
                own, raw, unit = packed
                for at in range(0, part.num_rows, 512):
                    some = part.slice(at, 512)
                    q, name = _matrix(some), column(some, "c").to_numpy(zero_copy_only=False)
                    near = _unit(q) @ unit.T
                    # all that reach the last place wanted, ties included; this product rounds otherwise than the score does
                    k = min(most, len(own))
                    least = np.partition(near, len(own) - k, axis=1)[:, len(own) - k] - 1e-9
                    reach = near >= least[:, None]
                    ends = np.cumsum(reach.sum(axis=1))
                    lo = 0
                    while lo < len(q):
                        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, "right")))
                        i, j = np.nonzero(reach[lo:hi])
                        exact = cosine(q[lo:hi][i], raw[j])
                        order = np.lexsort((own[j], -exact, i))
                        starts = np.concatenate(([0], np.flatnonzero(np.diff(i[order])) + 1))
                        place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
                        order = order[place < most]
                        yield pa.RecordBatch.from_arrays([pa.array(name[lo:hi][i[order]]), pa.array(own[j[order]]), pa.array(exact[order])], ["q", "c", "score"])
                        lo = hi

    return run


def _best(found: DataFrame, most: int) -> DataFrame:
    """Of (q, c, score) with repeats, each query's best ``most`` classes."""
    once = found.groupBy("q", "c").agg(F.max("score").alias("score"))
    order = Window.partitionBy("q").orderBy(F.col("score").desc(), "c")
    return once.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= most).select("q", "c", "score")


def _blocks(index: DataFrame, queries: DataFrame, sizes: DataFrame | None, most: int, kind: str) -> DataFrame:
    """Deals index and query rows to blocks of at most about BLOCK index rows and searches them."""
    if sizes is not None:
        index, queries = (x.join(sizes, ["t", "b"], "left").withColumn("g", F.coalesce("g", F.lit(1))) for x in (index, queries))
    index = index.withColumn("blk", F.pmod(F.xxhash64("c"), F.col("g")).cast("int")).withColumn("role", F.lit(0))
    queries = queries.withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).withColumn("role", F.lit(1))
    cols = ["t", "b", "blk", "role", "c", "v"]
    both = index.select(*cols).unionByName(queries.select(*cols)).repartition("t", "b", "blk").sortWithinPartitions("t", "b", "blk", "role")
    return both.mapInArrow(_search(most), f"q {kind}, c {kind}, score double")


def nearest(vectors: DataFrame, every: int, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest by cosine of each id divisible by ``every``.

    Candidates are all rows but those of the query's id; ties go to the smaller
    id.  Null, zero and non-finite vectors, vectors with null components, null ids
    and vectors of another dimension than most take no part.  Rows that repeat both id and
    vector count once.  A query whose buckets hold fewer than k candidates probes more of them,
    and is searched exactly, against all rows, in blocks, where that is no dearer.
    Floats are scored as they are; other numbers as doubles.
    """
    spark, v = vectors.sparkSession, F.col("v")
    single = vectors.schema[vector_col].dataType.simpleString() == "array<float>"
    sound = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    sound = sound.filter(F.forall(v, finite)).filter(F.exists(v, lambda x: x != 0))
    shape = sound.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "d").limit(1).collect()
    kind = sound.schema["id"].dataType.simpleString()
    if not shape:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    sound = sound.filter(F.size("v") == shape[0]["d"])
    once = stash(sound.groupBy("v", "id").agg(F.lit(1).alias("one")).select("id", "v"), "ann-rows")
    # of a class, the k + 1 smallest ids are enough: one may be the query's own
    least = once.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).filter(F.col("r") <= k + 1)
    classes = stash(least.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")).select(F.element_at("ids", 1).alias("c"), "ids", "v"), "ann-classes")
    asked = stash(once.filter(F.pmod("id", F.lit(every)) == 0).join(classes.select("v", "c"), "v").select("id", "c"), "ann-asked")
    wanted = stash(classes.join(asked.select("c").distinct(), "c", "left_semi").select("c", "v"), "ann-wanted")
    n = classes.count()
    axes = shape_of(n, shape[0]["d"])
    probes = probes_of(axes)

    index = Stash(_hashed(classes.select("c", "v"), axes, 1, seed), "ann-index")
    sizes = Stash(index.df.groupBy("t", "b").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("g")).filter("g > 1"), "ann-sizes")
    large = F.broadcast(sizes.df) if sizes.df.count() <= SMALL else sizes.df

    def search(queries: DataFrame, probes: int) -> DataFrame:
        return stash(_best(_blocks(index.df, _hashed(queries, axes, probes, seed), large, k + 1, kind), k + 1), "ann-found")

    def answers(best: DataFrame) -> DataFrame:
        named = best.join(classes.select("c", "ids"), "c").select("q", "score", F.explode("ids").alias("vec_id"))
        each = asked.join(named, asked["c"] == named["q"]).filter("vec_id != id").groupBy("id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("id").orderBy(F.col("score").desc(), "vec_id")
        return each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(F.col("id").alias("query_id"), "rank", "vec_id", "score")

    def short(found: DataFrame, of: DataFrame) -> DataFrame:
        """The classes (c, v) of queries that have fewer than k neighbours so far."""
        full = found.filter(F.col("rank") == k).select("query_id")
        rest = asked.join(full, asked["id"] == full["query_id"], "left_anti").select("c").distinct()
        return stash(of.join(rest, "c", "left_semi"), "ann-short")

    def again(found: DataFrame, few: DataFrame, more: DataFrame) -> DataFrame:
        done = asked.join(few, "c", "left_semi").select(F.col("id").alias("query_id"))
        return stash(found.join(done, "query_id", "left_anti").unionByName(more), "ann-again")

    found = stash(answers(search(wanted, probes)), "ann-first")
    few = short(found, wanted)
    most = math.prod(2 * a for a in axes)
    while probes < most and not few.isEmpty():  # eight times the probes for those that found too few
        probes = min(8 * probes, most)
        found = again(found, few, answers(search(few, probes)))
        few = short(found, few)
        if probes * TABLES > n // BLOCK:
            break  # the exact way is no dearer
    index.drop()
    if few.isEmpty():
        return found
    # the exact way for the rest
    g = max(1, -(-n // BLOCK))
    whole = [F.lit(-1).alias("t"), F.lit(0).cast("long").alias("b"), F.lit(g).alias("g"), "c", "v"]
    rest = _best(_blocks(classes.select(*whole), few.select(*whole), None, k + 1, kind), k + 1)
    return again(found, few, answers(rest))

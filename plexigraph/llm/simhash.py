"""SimHash near-duplicate detection by the general pigeonhole principle.

1. Every text becomes a 64-bit SimHash of its word shingles.
2. Equal fingerprints collapse to one row, so a group of exact copies of any
   size costs one row from here on.
3. One 64 x 64 matrix of bit co-occurrence over *all* fingerprints is the
   only corpus statistic.  From it, correlated bits are grouped into partitions,
   the number of candidates at every radius of every partition is estimated
   (a Markov chain along each partition's bits) and dynamic programming
   chooses the number of partitions and a radius for each.  If the radii
   satisfy sum(radius + 1) = max_bits + 1, any two fingerprints within
   ``max_bits`` agree to within the radius in at least one partition.
4. Each fingerprint probes its partitions' values and, for radius r, all values
   within ceil(r / 2) flips: two values at most r apart meet half way.  Probes that
   share a value are verified by exact Hamming distance; blocks report a spanning
   forest instead of their pairs, so that output stays linear.  A value that too many
   fingerprints share is split into chunks and every pair of chunks is verified by a
   task of its own.
5. Connected components of the forest edges give the classes.

Bits alone do not tell a similarity: of texts that share 0.8 of their shingles, 64 bits differ
in 10 on average, and searching that far means comparing a good part of all pairs.
:func:`keep_one` therefore searches several independent fingerprints, each to a small
radius, and measures the shared shingles of every edge that they give.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import Stash, column, mix64, raw_texts, stash

BITS = 64
#: Most members that one verification block holds.
BLOCK = 16_384
#: Rows up to which the table of ids to drop is broadcast.
SMALL = 200_000
#: Fingerprints of :func:`keep_one`, and the bits in which one of them may differ.  One finds a pair that shares
#: 0.8 of its shingles with a chance of 0.35, five with 0.88; at 0.85 and 0.9 these are 0.98 and 0.999.
HASHES, NEAR = 5, 8
#: Relative costs, in microseconds, of one shuffled probe and one comparison.
PROBE_COST, COMPARE_COST = 5.0, 0.001


# -- fingerprints ------------------------------------------------------------


def shingle_hashes(text: bytes, shingle: int, seed: int = 42) -> Iterator[int]:
    """The XXH64 of each shingle, repeats included; fewer words than a shingle: of the whole sequence; none: nothing."""
    words = text.lower().split()
    if not words:
        return
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        yield digest(joined, seed)
        return
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    for at in map(slice, starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist()):
        yield digest(joined[at], seed)


def majority(blocks: Iterator[np.ndarray]) -> int:
    """The fingerprint of hashes that come in blocks: the bits set in over half of them; zero for none."""
    n, total = 0, np.zeros(BITS, np.int64)
    for some in blocks:
        n += len(some)
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n, bitorder="little").tobytes(), "little")


def _blocks(hashes: Iterator[int]) -> Iterator[np.ndarray]:
    while len(some := np.fromiter(itertools.islice(hashes, 1 << 14), np.uint64)):
        yield some


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of one text; zero for a text without words."""
    return majority(_blocks(shingle_hashes(text, shingle, seed)))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(np.fromiter(shingle_hashes(text, shingle), np.uint64))


def set_fingerprints(text: bytes, shingle: int, hashes: int) -> list[int]:
    """Independent SimHashes of the set of a text's shingles: each from another mix of the same hashes."""
    known = shingle_set(text, shingle)
    cut = range(0, len(known), 1 << 14)
    return [majority(mix64(known[at : at + (1 << 14)] + np.uint64(k) * _STEP) for at in cut) for k in range(hashes)]


_STEP = np.uint64(0xD1B54A32D192ED03)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int = 4) -> DataFrame:
    """(id, fp long): the SimHash of every row's whole text.

    A null text counts as empty.  ``bytes.lower`` and ``bytes.split`` change
    and cut at ASCII characters only, which is what the operator asks for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([fingerprint(b"" if t is None else t.tobytes(), shingle) for t in raw_texts(column(b, "_text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([column(b, "_id"), pa.array(own.view(np.int64))], ["id", "fp"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, f"id {kind}, fp long")


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, hashes: int) -> DataFrame:
    """(id, key, f0, f1, ...): md5 and the set fingerprints of every row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([set_fingerprints(b"" if t is None else t.tobytes(), shingle, hashes) for t in raw_texts(column(b, "_text"))], np.uint64).reshape(-1, hashes)
            cols = [pa.array(np.ascontiguousarray(own[:, k]).view(np.int64)) for k in range(hashes)]
            yield pa.RecordBatch.from_arrays([column(b, "_id"), column(b, "_key"), *cols], ["id", "key", *(f"f{k}" for k in range(hashes))])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), F.md5(F.col(text_col)).alias("_key"))
    return rows.mapInArrow(run, ", ".join([f"id {kind}", "key string", *(f"f{k} long" for k in range(hashes))]))


# -- plan ---------------------------------------------------------------------


@dataclass(frozen=True)
class Plan:
    """Partitions (tuples of bit positions) and the radius probed in each."""

    parts: tuple[tuple[int, ...], ...]
    radii: tuple[int, ...]

    def rows(self) -> int:
        """Probes per fingerprint."""
        return sum(_ball(len(p), _flips(r)) for p, r in zip(self.parts, self.radii, strict=True))


def _flips(radius: int) -> int:
    """Flips that each side makes, so that values at most ``radius`` apart meet; -1: no probe."""
    return (radius + 1) // 2 if radius >= 0 else -1


def _ball(width: int, radius: int) -> int:
    return sum(math.comb(width, k) for k in range(radius + 1))


def cooccurrence(rows: DataFrame, cols: list[str]) -> tuple[int, list[np.ndarray]]:
    """The number of rows, and how often each two bits of each column are both set.

    Sums of one 64 x 64 matrix a column and task: 4096 numbers each, whatever the corpus holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((len(cols), BITS, BITS), np.int64), 0
        for b in batches:
            for at in range(0, b.num_rows, 1 << 14):
                for k, c in enumerate(cols):
                    x = _bits(column(b, c).slice(at, 1 << 14).to_numpy(zero_copy_only=False).astype(np.int64)).astype(np.float32)
                    total[k] += np.rint(x.T @ x).astype(np.int64)
            n += b.num_rows
        if n:
            cells = np.append(total.ravel(), n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cells), dtype=np.int32)), pa.array(cells)], ["cell", "n"])

    found = rows.select(*cols).mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    cells = np.zeros(len(cols) * BITS * BITS + 1, np.int64)
    for r in found:
        cells[r["cell"]] = r["n"]
    return int(cells[-1]), list(cells[:-1].reshape(len(cols), BITS, BITS))


def _bits(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(n: int, both: np.ndarray, m: int) -> list[tuple[int, ...]]:
    """m partitions of nearly equal width, each of bits that correlate.

    Greedy: a partition begins with the unused bit that correlates most with
    the other unused bits and takes, one after the other, the bit with the largest mean
    correlation to those already taken.  Correlated bits together make a
    partition's values uneven, which its radius then answers to.
    """
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    left, parts = list(range(BITS)), []
    for k in range(m):
        width = len(left) // (m - k)
        taken = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(taken[0])
        while len(taken) < width:
            best = max(left, key=lambda b: (corr[b, taken].mean(), -b))
            taken.append(best)
            left.remove(best)
        parts.append(tuple(taken))
    return parts


def within(n: int, both: np.ndarray, part: tuple[int, ...], most: int) -> np.ndarray:
    """P(two fingerprints differ in at most r of the partition's bits), r = 0..most.

    A Markov chain along the bits: whether the two agree in a bit depends
    on whether they agreed in the bit before, with probabilities from the two bits'
    joint distribution.
    """
    joint = lambda a, b: np.array([[n - both[a, a] - both[b, b] + both[a, b], both[b, b] - both[a, b]], [both[a, a] - both[a, b], both[a, b]]], float) / max(n, 1)
    p = both[part[0], part[0]] / max(n, 1)
    state = np.zeros((2, most + 2))  # differs in this bit x number of differences (the last: more)
    state[0, 0], state[1, min(1, most + 1)] = p * p + (1 - p) * (1 - p), 2 * p * (1 - p)
    for a, b in zip(part, part[1:], strict=False):
        j = joint(a, b)
        move = np.zeros((2, 2))
        for (u, v), (x, y) in itertools.product(itertools.product((0, 1), repeat=2), repeat=2):
            move[int(u != x), int(v != y)] += j[u, v] * j[x, y]
        move /= np.maximum(move.sum(1, keepdims=True), 1e-300)
        new = np.zeros_like(state)
        for u in (0, 1):
            new[0] += state[u] * move[u, 0]
            up = state[u] * move[u, 1]
            new[1, 1:] += up[:-1]
            new[1, -1] += up[-1]
        state = new
    return np.cumsum(state.sum(0))[: most + 1]


def choose_plan(n: int, both: np.ndarray, max_bits: int) -> Plan:
    """The cheapest partitions and radii for n fingerprints.

    For each number of partitions m, dynamic programming shares max_bits + 1
    units among them; u units mean radius u - 1, and none that the partition is
    not probed.  Cost: probes to shuffle, and expected comparisons.
    """
    best: tuple[float, Plan] | None = None
    for m in range(1, max_bits + 2):
        parts = group_bits(n, both, m)
        units = max_bits + 1
        costs = np.full((m, units + 1), np.inf)
        for i, part in enumerate(parts):
            w = len(part)
            near = within(n, both, part, units + 1)
            costs[i, 0] = 0
            for u in range(1, min(units, w) + 1):
                reach = min(2 * _flips(u - 1), w)
                if (rows := _ball(w, _flips(u - 1))) <= 20_000:
                    # were values even, a share ball(reach) / 2 ** w of pairs would lie within reach,
                    # and each meet rows ** 2 / ball(reach) times
                    pairs = n * max(near[min(reach, units + 1)], _ball(w, reach) / 2.0**w) * rows * rows / _ball(w, reach)
                    chunks = max(1.0, n * rows / 2.0**w / (BLOCK // 2))  # copies of a row where values are split
                    costs[i, u] = n * (rows * chunks * PROBE_COST + pairs * COMPARE_COST)
        table, choice = np.full((m + 1, units + 1), np.inf), np.zeros((m + 1, units + 1), int)
        table[0, 0] = 0
        for i in range(m):
            for have in range(units + 1):
                each = [table[i, have - u] + costs[i, u] for u in range(have + 1)]
                choice[i + 1, have] = int(np.argmin(each))
                table[i + 1, have] = min(each)
        if math.isfinite(cost := float(table[m, units])) and (best is None or cost < best[0]):
            got, have = [], units
            for i in range(m, 0, -1):
                got.append(int(choice[i, have]) - 1)
                have -= choice[i, have]
            best = cost, Plan(tuple(parts), tuple(got[::-1]))
    assert best
    return best[1]


# -- probe and verify -----------------------------------------------------------


def _keys(fp: np.ndarray, plan: Plan) -> Iterator[tuple[int, np.ndarray]]:
    """(partition, key) arrays: the partition's bits, with every combination of flips."""
    bits = _bits(fp)
    for i, (part, radius) in enumerate(zip(plan.parts, plan.radii, strict=True)):
        own = bits[:, list(part)].astype(np.uint64) @ (np.uint64(1) << np.arange(len(part), dtype=np.uint64))
        for r in range(_flips(radius) + 1):
            for flips in itertools.combinations(range(len(part)), r):
                yield i, own ^ np.uint64(sum(1 << f for f in flips))


def probes(rows: DataFrame, plans: dict[str, Plan]) -> DataFrame:
    """(part, key, fp, node) for each probe of each fingerprint column; parts are numbered through."""
    start = dict(zip(plans, itertools.accumulate([0, *(len(p.parts) for p in plans.values())]), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1 << 13):
                node = column(b, "node").slice(at, 1 << 13)
                for c, plan in plans.items():
                    fp = column(b, c).slice(at, 1 << 13).to_numpy(zero_copy_only=False).astype(np.int64)
                    for i, key in _keys(fp, plan):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), start[c] + i, np.int32)), pa.array(key.view(np.int64)), pa.array(fp), node], ["part", "key", "fp", "node"])

    return rows.select("node", *plans).mapInArrow(run, "part int, key long, fp long, node long")


def forest(fp: np.ndarray, node: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, the node through which it was reached) for the members of one block that are not their component's first.

    Two are linked if the fingerprints differ in at most ``max_bits`` bits.  A search takes each
    member out of the unvisited ones when it is first reached; memory is one row of distances at a time.
    """
    order = np.lexsort((node, fp))
    left, names = fp.view(np.uint64)[order], node[order]
    members, through = [], []
    while len(left):
        queue = [(left[0], names[0])]
        left, names = left[1:], names[1:]
        while queue and len(left):
            x, name = queue.pop()
            hit = np.bitwise_count(left ^ x) <= max_bits
            if hit.any():
                queue.extend(zip(left[hit], names[hit], strict=True))
                members.append(names[hit])
                through.append(np.full(int(hit.sum()), name))
                left, names = left[~hit], names[~hit]
    if not members:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(members), np.concatenate(through)


def _verify(max_bits: int):
    """For rows sorted by block: the forest of each block, blocks may span batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_key, kept = None, []
        edges: list[tuple[np.ndarray, np.ndarray]] = []

        def close() -> None:
            if sum(len(x[0]) for x in kept) > 1:
                # flips on both sides may bring a node to one value twice
                node, first = np.unique(np.concatenate([x[1] for x in kept]), return_index=True)
                found = forest(np.concatenate([x[0] for x in kept])[first], node, max_bits)
                if len(found[0]):
                    edges.append(found)

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*edges, strict=True)], ["a", "b"])
            edges.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [column(batch, c).to_numpy(zero_copy_only=False) for c in ("part", "key", "blk")]
            fp, node = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("fp", "node"))
            new = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
            bounds = [0, *new.tolist(), len(fp)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                key = tuple(int(c[lo]) for c in cols)
                if key != kept_key:
                    close()
                    kept_key, kept = key, []
                kept.append((fp[lo:hi], node[lo:hi]))
            if sum(len(e[0]) for e in edges) > 10_000:
                yield flush()
        close()
        if edges:
            yield flush()

    return run


def link_forest(rows: DataFrame, plans: dict[str, Plan], max_bits: int) -> DataFrame:
    """(a, b): edges between nodes whose components are those of all links.

    ``rows`` has (node long) and the fingerprint columns that ``plans`` names; a link is a difference
    of at most ``max_bits`` bits in one of them.  Values with a single prober go first, by a map-side-combined
    count.  Values with more than BLOCK probers are dealt into chunks; block (i, j) holds
    the chunks i and j, so that every two probers meet in some block.
    """
    all_probes = Stash(probes(rows, plans), "simhash-probes")
    p = all_probes.df
    sizes = p.groupBy("part", "key").agg(F.count("*").alias("n")).filter("n > 1")
    chunks = F.when(F.col("n") <= BLOCK, 1).otherwise(F.ceil(F.col("n") / (BLOCK // 2))).cast("int")
    pair = F.least("own", "other") * F.col("g") + F.greatest("own", "other")
    dealt = (
        p.join(sizes.select("part", "key", chunks.alias("g")), ["part", "key"])
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
        .filter("g = 1 or other != own")
        .select("part", "key", F.when(F.col("g") == 1, 0).otherwise(pair).alias("blk"), "fp", "node")
    )
    spread = dealt.repartition("part", "key", "blk").sortWithinPartitions("part", "key", "blk")
    edges = stash(spread.mapInArrow(_verify(max_bits), "a long, b long").distinct(), "simhash-edges")
    all_probes.drop()
    return edges


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root): the least node reachable, for every node that has an edge.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each
    round is two map-side-combined minima and two joins that can be split where
    a node is hot; the number of rounds grows with the logarithm of the path length.
    Every round's edges, and the minima before they are joined, are written to the
    shared folder; those of the round before are deleted.
    """
    minima: list[Stash] = []

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e
        minima.append(Stash(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "cc-min"))
        least = minima[-1].df
        joined = both.join(least, "a")
        if large:
            moved = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.filter("a != b").distinct()

    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    now = Stash(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "cc")
    seen = mark(now.df)
    for _ in range(most_rounds):
        large = Stash(star(now.df, True), "cc")
        new = Stash(star(large.df, False), "cc")
        for done in (now, large, *minima):
            done.drop()
        minima.clear()
        now, was, seen = new, seen, mark(new.df)
        if seen == was:
            return now.df.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.df.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"no fixpoint after {most_rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, max_bits: int = 4) -> DataFrame:
    """One row per document: (id_col, fp long, component_id).

    ``component_id`` is the least id that a chain of links (fingerprints at most
    ``max_bits`` apart) reaches, itself included.  Null and empty texts
    have fingerprint zero and link like any other.  Rows that repeat an id each
    return a row.  Null ids are never a component's id unless it has no other.
    An empty table returns no rows.  Other columns of ``docs`` are not read.
    """
    each = stash(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    distinct = Stash(each.groupBy("fp").agg(F.min("id").alias("least")), "simhash-distinct")
    n, both = cooccurrence(distinct.df, ["fp"])
    edges = link_forest(distinct.df.withColumn("node", F.col("fp")), {"fp": choose_plan(n, both[0], max_bits)}, max_bits)
    comp = components(edges)
    rooted = distinct.df.join(comp, distinct.df["fp"] == comp["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = Stash(rooted, "simhash-rooted")
    # written first, so that the join has plain exchanges on both sides and a hot root can be split
    ids = Stash(rooted.df.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-ids")
    classes = stash(rooted.df.join(ids.df, "root").select("fp", "component_id"), "simhash-classes")
    for done in (distinct, rooted, ids):
        done.drop()
    return each.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, text) to (node, s array<long>): the distinct hashes of a text's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                found = [shingle_set(b"" if t is None else t.tobytes(), shingle).view(np.int64) for t in raw_texts(column(b, "text"))]
                ends = np.cumsum([0, *map(len, found)])
                yield pa.RecordBatch.from_arrays([column(b, "node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(found)))], ["node", "s"])

    return texts.select("node", "text").mapInArrow(run, "node long, s array<long>")


def _alike(edges: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, shingle: int, similar: float) -> DataFrame:
    """The edges whose two texts share ``similar`` or more of the shingles that either has.

    ``reps`` has (node, id, key) of a text for each node.  Only texts of nodes with an edge are read
    into sets, once each.
    """
    ends = Stash(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(reps, "node"), "simhash-ends").df
    few = F.broadcast(ends) if ends.count() <= SMALL else ends
    own = docs.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text")).withColumn("key_", F.md5("text"))
    found = own.join(few, F.col("id_").eqNullSafe(F.col("id")) & F.col("key_").eqNullSafe(F.col("key"))).select("node", "text")
    sets = Stash(_sets(found, shingle).dropDuplicates(["node"]), "simhash-sets").df
    a, b = sets.select(F.col("node").alias("a"), F.col("s").alias("sa")), sets.select(F.col("node").alias("b"), F.col("s").alias("sb"))
    shared = edges.join(a, "a").join(b, "b").select("a", "b", F.size(F.array_intersect("sa", "sb")).alias("same"), (F.size("sa") + F.size("sb")).alias("sum"))
    return stash(shared.filter(F.col("same") >= F.lit(similar) * (F.col("sum") - F.col("same")) - 1e-9).select("a", "b"), "simhash-alike")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = NEAR, hashes: int = HASHES, similar: float = 0.8) -> DataFrame:
    """``docs``, all columns of any name, with one document of each near-duplicate group.

    Two texts are linked if one of ``hashes`` independent fingerprints of their sets of shingles differs in at most
    ``max_bits`` bits and they share ``similar`` or more of their distinct shingles (Jaccard).  Texts
    equal in all fingerprints are one.  Of texts that many others resemble, the pairs measured are those of
    spanning forests, so a pair may only be linked through others.

    The document of least id stays (null last), of several rows with that id the one whose text has the
    least md5, and of rows equal in both, one.  Null and empty texts are alike and like nothing else.
    Only the documents to drop, and those that repeat, are joined to the texts: broadcast while a count shows
    that they are few.  An empty table stays empty.
    """
    fps = [f"f{k}" for k in range(hashes)]
    place = F.struct(F.col("id").isNull().alias("last"), "id", F.coalesce("key", F.lit("")).alias("key"))
    each = stash(signatures(docs, id_col, text_col, shingle, hashes), "simhash-fp")
    # numbers given once, as the table is written
    nodes = stash(each.groupBy(*fps).agg(F.min(F.struct(place.alias("p"), "id", "key")).alias("rep")).withColumn("node", F.monotonically_increasing_id()), "simhash-nodes")
    n, both = cooccurrence(nodes, fps)
    plans = {c: choose_plan(n, x, max_bits) for c, x in zip(fps, both, strict=True)}
    edges = link_forest(nodes, plans, max_bits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    comp = components(_alike(stash(edges, "simhash-pairs"), nodes.select("node", "rep.id", "rep.key"), docs, id_col, text_col, shingle, similar))
    rooted = stash(nodes.join(comp.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select(*fps, F.coalesce("root", "node").alias("root")), "simhash-rooted")
    counted = Stash(each.join(rooted, fps).groupBy("root", "id", "key").agg(F.count("*").alias("n")), "simhash-counted").df
    first = Stash(counted.groupBy("root").agg(F.min(place).alias("first")), "simhash-first").df
    judged = counted.join(first, "root").withColumn("other", place != F.col("first")).filter("other or n > 1")
    odd = stash(judged.select("id", "key", "other"), "simhash-odd")
    few = F.broadcast(odd) if odd.count() <= SMALL else odd
    held = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("own_id"), F.md5(F.col(text_col)).alias("own_key"))
    marked = held.join(few, F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_key").eqNullSafe(F.col("key")), "left")
    once = marked.filter("other is null").select("doc.*")
    if odd.filter("not other").isEmpty():
        return once
    return once.unionByName(marked.filter("not other").dropDuplicates(["own_id", "own_key"]).select("doc.*"))

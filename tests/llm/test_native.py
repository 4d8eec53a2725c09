"""Mixing, line dedup and packing: SQL, brute force and edge cases."""

import random

import pytest
from pyspark.sql import functions as F

from plexigraph.llm import linededup, mixing, packing, queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    """Documents from (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, None, s, None) for i, t, s in rows], DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracle(spark, name):
    same(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF)


def water(sizes):
    """Targets by repeated resharing, over sources in code point order, null last."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: 1 + i % 3 for i, s in enumerate(names)}
    target, open_, rest = {}, set(names), float(sum(sizes.values()))
    while open_:
        level = rest / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * level > 3 * sizes[s]]
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 3.0 * sizes[s]
            rest -= target[s]
            open_.discard(s)
    return target


def mixed(spark, rows, **options):
    return mixing.pareto_mix(frame(spark, rows), **options).collect()


@pytest.mark.parametrize("seed", range(3))
def test_mix(spark, seed):
    rng = random.Random(seed)
    names = ["a", "b", "é", "Z", None, "tiny"]
    rows = [(i, " ".join("w" * 1 for _ in range(rng.randrange(60))), rng.choice(names[:5])) for i in range(800)] + [(9000, "one two", "tiny"), (9001, None, "a"), (9002, "", None)]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    want = water(sizes)
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    taken = {}
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60 + 1
    assert sorted(map(str, got)) == sorted(map(str, mixed(spark, rows)))


def test_mix_is_unequal_where_weights_are(spark):
    rows = [(i, "word " * 10, "s" if i % 2 else "t") for i in range(2000)]
    docs = frame(spark, rows).withColumn("weight", F.when(F.col("doc_id") % 4 < 2, 3.0).otherwise(1.0))
    got = mixing.pareto_mix(docs, weight_col="weight").filter("source = 's'").collect()
    heavy = [r["copies"] for r in got if r["id"] % 4 < 2]
    light = [r["copies"] for r in got if r["id"] % 4 >= 2]
    assert sum(heavy) / len(heavy) == pytest.approx(3 * sum(light) / len(light), rel=0.15)


def test_mix_is_unequal_by_size(spark):
    """Copies of long and short documents of a source are as their weights, and as expected over many documents."""
    rows = [(i, "w " * (4 if i % 2 else 200), "s" if i < 4000 else "t") for i in range(6000)]
    got = [r for r in mixed(spark, rows) if r["source"] == "s"]
    mean = {n: sum(r["copies"] for r in got if r["size"] == n) / 2000 for n in (4, 200)}
    assert mean[200] / mean[4] == pytest.approx((8 + 8) / (8 + 3), rel=0.1)
    assert sum(r["copies"] * r["size"] for r in got) == pytest.approx(got[0]["target"], abs=200)


def test_mix_takes_all_of_a_source_at_its_cap(spark):
    rows = [(i, "w " * (1 + i % 50), "tiny" if i < 100 else "zeta") for i in range(6000)]
    tiny = [r for r in mixed(spark, rows, weights=(3, 1)) if r["source"] == "tiny"]
    assert {r["copies"] for r in tiny} == {3}


def test_mix_edges(spark):
    assert mixed(spark, []) == []
    assert {r["copies"] * r["size"] for r in mixed(spark, [(None, None, None), (None, None, None)])} == {0}
    twice = mixed(spark, [(1, "a b", "s")] * 3 + [(2, "c", "t")])
    assert len(twice) == 4 and len({r["copies"] for r in twice if r["id"] == 1}) == 1
    clash = frame(spark, [(1, "a b c", "s"), (2, "x", "t")]).withColumn("size", F.lit("x")).withColumn("copies", F.lit(9)).withColumn("key", F.lit(0))
    back = mixing.take(clash, mixing.fit_mix(clash))
    assert back.columns == clash.columns
    assert back.count() == sum(r["copies"] for r in mixing.pareto_mix(clash).collect())
    long = mixed(spark, [(1, "w " * 300_000, "s"), (2, "w", "t")])
    assert {r["id"]: r["size"] for r in long} == {1: 300_000, 2: 1}


# -- lines ------------------------------------------------------------------------


def chunks_of(lines, every=2):
    """(start, end) of a text's chunks."""
    import hashlib

    h = [int(hashlib.md5(x.encode()).hexdigest()[:7], 16) for x in lines]
    out, start = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or (h[i] * 31 + (h[i - 1] if i else 0)) % 1_000_003 % every == 0:
            out.append((start, i + 1))
            start = i + 1
    return out


def brute_lines(rows):
    import hashlib

    first, gone = {}, {}
    for i, t in sorted(((i, t) for i, t in set(rows) if t is not None), key=lambda x: (x[0] is None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest())):
        lines = t.split("\n")
        for s, e in chunks_of(lines):
            body = "\n".join(lines[s:e])
            if e - s < 2 or not body.strip(" \t\n\x0b\x0c\r"):
                continue
            other, s1 = first.setdefault(body, (lines, s))
            if other is lines and s1 == s:
                continue
            e1 = s1 + e - s
            for _ in range(16):
                if s and s1 and lines[s - 1] == other[s1 - 1]:
                    s, s1 = s - 1, s1 - 1
            for k in range(16):
                if not (e < len(lines) and e1 < len(other) and lines[e] == other[e1]):
                    break
                e, e1 = e + 1, e1 + 1
            gone.setdefault((i, t), set()).update(range(s, e))
    left = lambda i, t: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get((i, t), ()))
    return [(i, None if t is None else left(i, t)) for i, t in rows]


def test_lines(spark):
    rng = random.Random(5)
    lines = [f"line {k} {'x' * rng.randrange(9)}" for k in range(40)] + ["", " "]
    block = [f"shared {k}" for k in range(12)]
    rows = [(i, "\n".join([rng.choice(lines) for _ in range(rng.randrange(5))] + block * (i % 3 == 0) + [rng.choice(lines) for _ in range(rng.randrange(5))])) for i in range(60)]
    rows += [(100, None), (101, ""), (102, "\n\n\n\n"), (103, "\n\n\n\n"), (104, "one line"), (105, "one line"), (None, "a\nb\nc\nd"), (106, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), rows[3], rows[3]]
    docs = frame(spark, [(i, t, None) for i, t in rows])
    got = linededup.dedup_lines(docs).collect()
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted([(r["doc_id"], r["text"]) for r in got], key=key) == sorted(brute_lines(rows), key=key)
    assert sum(r["removed"] for r in linededup.judged(docs).collect()) > 10


def test_lines_resist_shifts(spark):
    body = [f"row {i}" for i in range(60)]
    rows = [(1, "\n".join(body), None), (2, "\n".join(["inserted", "two", *body]), None)]
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame(spark, rows)).collect()}
    assert got[1] == rows[0][1] and got[2] == "inserted\ntwo"


def test_short_blocks(spark):
    """Of blocks that two otherwise different texts share, nearly all lines go where a chunk lies inside; every text keeps its own lines."""
    rng = random.Random(3)
    own = lambda: [f"own {rng.random()}" for _ in range(6)]
    share = {}
    for n in (4, 8, 20):
        rows, blocks = [], []
        for i in range(0, 120, 2):
            blocks.append([f"block {rng.random()}" for _ in range(n)])
            rows += [(i + k, "\n".join([*own(), *blocks[-1], *own()]), None) for k in range(2)]
        got = {r["doc_id"]: r["text"].split("\n") for r in linededup.dedup_lines(frame(spark, rows)).collect()}
        assert all(got[i] == t.split("\n") for i, t, _ in rows if i % 2 == 0)
        assert all(sum(x.startswith("own") for x in got[i]) == 12 for i, _, _ in rows)
        share[n] = sum(len(t.split("\n")) - len(got[i]) for i, t, _ in rows) / (60 * n)
    assert share[4] > 0.1 and share[8] > 0.65 and share[20] > 0.97


def test_lines_edges(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    names = ("id", "key", "h", "__id", "__key", "__gone", "__kept", "__chunks", "__removed", "kept", "removed", "chunks", "doc", "own_id", "own_text")
    clash = frame(spark, [(1, "a\nb\nc", "s"), (2, "a\nb\nc", "s")]).withColumns({n: F.lit(n) for n in names})
    out = linededup.dedup_lines(clash)
    assert out.columns == clash.columns and out.count() == 2 and all(r[n] == n for r in out.collect() for n in names)
    none = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(frame(spark, [(None, "q\nr\ns\nt", None), (1, "q\nr\ns\nt", None)])).collect()}
    assert none == {1: "q\nr\ns\nt", None: brute_lines([(None, "q\nr\ns\nt"), (1, "q\nr\ns\nt")])[0][1]} and none[None] != none[1]
    long = "\n".join(f"l{i % 5000}" for i in range(20_000))
    assert linededup.judged(frame(spark, [(1, long, None)])).first()["removed"] > 100


# -- packing ------------------------------------------------------------------------


def test_boundaries_are_optimal():
    import itertools

    rng = random.Random(2)
    for _ in range(30):
        hist = {rng.randrange(1, 30): rng.randrange(1, 9) for _ in range(rng.randrange(1, 9))}
        for k in (1, 2, 3):
            cuts = packing.boundaries(hist, k)
            pad = lambda cs: sum(n * (min(c for c in cs if c >= x) - x) for x, n in hist.items())
            best = min(pad(c) for r in range(1, k + 1) for c in itertools.combinations(sorted(hist), r) if c[-1] == max(hist))
            assert pad(cuts) == best and len(cuts) <= k
    assert packing.boundaries({}, 3) == [] == packing.boundaries({0: 4}, 3)


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "SLICE", 7)
    rng = random.Random(4)
    rows = [(i, "w " * n, "s") for i, n in enumerate([0, 1, 5, 16, 17, 400] + [rng.randrange(1, 40) for _ in range(200)])] + [(None, "a b", None), (7, None, None), (8, "w w", None), (8, "w w", None)]
    got = packing.pack(frame(spark, rows), window=16, buckets=3, budget=64).collect()
    sizes = {}
    for r in got:
        sizes.setdefault(r["doc_id"], 0)
        sizes[r["doc_id"]] += r["n_tokens"]
    want = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + len((t or "").split())
    assert sizes == want
    packed = [r for r in got if r["n_tokens"]]
    assert all(r["batch"] is None for r in got if not r["n_tokens"])
    places = [(r["bucket_len"], r["batch"], r["slot"]) for r in packed]
    assert len(set(places)) == len(places)
    for b in {r["bucket_len"] for r in packed}:
        room = max(1, 64 // b)
        mine = sorted((r["batch"], r["slot"]) for r in packed if r["bucket_len"] == b)
        assert mine == [(k // room, k % room) for k in range(len(mine))]
    assert all(r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0 for r in packed)
    assert packing.pack(frame(spark, [])).count() == 0
    clash = frame(spark, rows).withColumn("id", F.lit(1)).withColumn("len", F.lit(2)).withColumn("n", F.lit(3))
    assert packing.pack(clash).count() > 0

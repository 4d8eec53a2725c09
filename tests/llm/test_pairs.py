"""SimHash, substring chaining and nearest neighbours against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from plexigraph.llm import ann, simhash, substring
from plexigraph.llm.common import ship

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    ship(spark)
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS)


def plain_fingerprint(text, k=4):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(nodes, linked):
    """Least member by union-find over all pairs."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {n: find(n) for n in nodes}


def test_fingerprints():
    for t in ("", " \t\n\x0b\x0c\r", "Ä ÄB a", "one", "a b c", "a b c d e A B", "a b   x y z q", "x " * 50_000):
        assert simhash.fingerprint(t.encode()) == plain_fingerprint(t), t[:20]


def near_rows(rng):
    words = [f"w{i}" for i in range(300)]
    rows, base = [], [" ".join(rng.choices(words, k=80)) for _ in range(6)]
    for i in range(150):
        t = rng.choice(base).split() if rng.random() < 0.8 else rng.choices(words, k=rng.randrange(1, 60))
        for _ in range(rng.randrange(3)):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((i, " ".join(t)))
    return rows + [(900, None), (901, ""), (902, "  "), (5, rows[5][1]), (5, rows[6][1]), (903, "x " * 100_000)]


@pytest.mark.parametrize("block", [4096, 8])
def test_classes(spark, monkeypatch, block):
    """With tiny blocks every shared value is split into chunks."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = near_rows(random.Random(block))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = {plain_fingerprint(t or "") for _, t in rows}
    root = classes(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for i, t in rows:
        f = root[plain_fingerprint(t or "")]
        least[f] = min(least.get(f, i), i)
    want = sorted((i, plain_fingerprint(t or ""), least[root[plain_fingerprint(t or "")]]) for i, t in rows)
    assert sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == want


@pytest.mark.parametrize("radii", [(2, 1), (3, 0), (0, -1, 2, 0)])
def test_classes_by_unequal_radii(spark, monkeypatch, radii):
    """The whole operator with a forced plan of unequal thresholds, as large tables get."""
    plan = simhash.Plan(tuple(simhash.group_bits(1000, np.full((64, 64), 250) + 250 * np.eye(64, dtype=int), len(radii))), radii)
    monkeypatch.setattr(simhash, "choose_plan", lambda n, both, bits: plan)
    if plan.rows() > 700:  # balls of 64 bits within two flips: the same with fewer documents
        rows = near_rows(random.Random(1))[:40]
    else:
        rows = near_rows(random.Random(1))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frame(spark, rows)).collect()}
    fps = {i: plain_fingerprint(t or "") for i, t in rows}
    if len(fps) == len(rows):
        assert got == classes(sorted(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    else:
        distinct = set(plain_fingerprint(t or "") for _, t in rows)
        root, least = classes(distinct, lambda a, b: (a ^ b).bit_count() <= 4), {}
        for i, t in rows:
            f = root[plain_fingerprint(t or "")]
            least[f] = min(least.get(f, i), i)
        assert sorted(got) == sorted(fps) and all(got[i] in {least[root[plain_fingerprint(t or "")]] for j, t in rows if j == i} for i in fps)


def shingles(text, k=5):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_keep_one_by_similarity(spark):
    """Pairs of every similarity: above 0.8 one of the two goes, below both stay."""
    rng = random.Random(41)
    vocab = [f"w{i}" for i in range(2000)]
    rows = []
    for i in range(300):
        words = rng.choices(vocab, k=rng.randrange(60, 300))
        near = words.copy()
        for _ in range(rng.randrange(0, max(2, len(words) // 25))):
            near[rng.randrange(len(near))] = rng.choice(vocab)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(near))]
    kept = {r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect()}
    text, found = dict(rows), {"low": [], "near": [], "high": []}
    assert {2 * i for i in range(300)} <= kept
    for i in range(300):
        j = jaccard(shingles(text[2 * i]), shingles(text[2 * i + 1]))
        found["low" if j < 0.8 else "near" if j < 0.85 else "high"].append(2 * i + 1 not in kept)
    share = {k: sum(v) / len(v) for k, v in found.items()}
    assert all(len(v) > 20 for v in found.values()) and share["low"] == 0 and share["near"] >= 0.8 and share["high"] >= 0.97


def test_keep_one_with_names_of_its_own(spark):
    """Columns may have the names that the code uses."""
    names = ("__id", "__key", "__other", "id", "key", "other", "own_id", "own_key", "node", "root", "f0", "fp", "doc", "text2")
    docs = frame(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "")]).withColumns({n: F.lit(n) for n in names})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    assert all(r[n] == n for r in kept.collect() for n in names)


def test_every_plan_finds_every_link():
    """Whatever the partitions and radii, two fingerprints within the bound share a probe."""
    rng = np.random.default_rng(1)
    both = np.full((64, 64), 250)
    np.fill_diagonal(both, 500)
    plans = {simhash.choose_plan(n, both * n // 1000, bits) for n in (1000, 10**6, 10**8, 10**10) for bits in (4, 10, 13)}
    assert any(len(set(p.radii)) > 1 for p in plans)
    for plan in plans:
        if plan.rows() > 500:
            continue
        bound = sum(r + 1 for r in plan.radii) - 1
        assert sorted(b for p in plan.parts for b in p) == list(range(64))
        a = rng.integers(-(1 << 63), 1 << 63, 200)
        b = a.copy()
        for i in range(len(b)):
            for bit in rng.choice(64, rng.integers(0, bound + 1), replace=False):
                b[i] ^= np.int64(np.uint64(1 << int(bit)).view(np.int64))
        ka, kb = (list(simhash._keys(x, plan)) for x in (a, b))
        for i in range(len(a)):
            assert {(p, int(k[i])) for p, k in ka} & {(p, int(k[i])) for p, k in kb}


def test_correlated_bits_share_a_partition():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (4000, 64))
    x[:, 40] = x[:, 3]
    x[:, 17] = x[:, 3]
    parts = simhash.group_bits(len(x), x.T @ x, 4)
    assert any({3, 17, 40} <= set(p) for p in parts)
    near = simhash.within(len(x), x.T @ x, (3, 17, 40), 2)
    assert near[0] == pytest.approx(0.5, abs=0.03) and near[2] == pytest.approx(0.5, abs=0.03)


def test_simhash_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.near_duplicates(frame(spark, [(None, "a"), (None, "a")])).select("component_id").distinct().first()[0] is None
    clash = frame(spark, [(1, "a b"), (2, "a b"), (3, "q r s")]).withColumn("fp", F.lit(1)).withColumn("id", F.lit("x")).withColumn("component_id", F.lit(0))
    kept = simhash.keep_one(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 3]
    rows = [(1, "same text here"), (1, "same text here"), (2, "same text here"), (3, "other"), (3, "quite another"), (None, "alone"), (None, "lonely"), (None, "other"), (None, "alone"), (8, None), (7, "")]
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in kept) == [("1", "same text here"), ("3", "other"), ("3", "quite another"), ("7", ""), ("None", "alone"), ("None", "lonely")]


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}


# -- passages ------------------------------------------------------------------------


def test_chains_match_brute_force():
    """The best chain's score, against dynamic programming over all pairs."""
    rng = random.Random(9)
    for _ in range(40):
        n = rng.randrange(2, 25)
        pairs = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(n)})
        a, b = (np.array(x) for x in zip(*pairs, strict=True))
        best = [0.0] * len(pairs)
        for i in sorted(range(len(pairs)), key=lambda i: (b[i], a[i])):
            best[i] = 1 + max([0.0, *(best[j] - substring.GAP * (a[i] - a[j] + b[i] - b[j]) for j in range(len(pairs)) if a[j] < a[i] and b[j] < b[i])])
        score = lambda c: len(c) - substring.GAP * (a[c[-1]] - a[c[0]] + b[c[-1]] - b[c[0]])
        found = substring.chains(a, b, least=1)
        assert max(score(c) for c in found) == pytest.approx(max(best))
        assert sorted(i for c in found for i in c.tolist()) == list(range(len(pairs)))
        assert all((np.diff(a[c]) > 0).all() and (np.diff(b[c]) > 0).all() for c in found)


def test_ends_are_found_once():
    """A chain whose sides are too unlike in length is parted without an alignment."""
    x = np.arange(60, dtype=np.uint64)
    a, b = np.concatenate((x, 1000 + x)), np.concatenate((x, 5000 + np.arange(90, dtype=np.uint64), 1000 + x))
    seed, other = np.array([0, 30, 70, 110]), np.array([0, 30, 160, 200])
    ends = substring.reach(a, b, seed, other)
    assert ends == (0, 120, 0, 210)
    assert sorted(substring.passages(a, b, seed, other, ends, 50, 0.8)) == [(0, 60, 0, 60, 60, 1.0), (60, 120, 150, 210, 60, 1.0)]


def test_common_matches_brute_force():
    rng = random.Random(3)
    for _ in range(50):
        x, y = ([rng.randrange(5) for _ in range(rng.randrange(1, 90))] for _ in "ab")
        t = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, u in enumerate(x):
            for j, v in enumerate(y):
                t[i + 1][j + 1] = t[i][j] + 1 if u == v else max(t[i][j + 1], t[i + 1][j])
        assert substring.common(np.array(x), np.array(y)) == t[-1][-1]


def test_a_common_run_shares_a_seed():
    rng = np.random.default_rng(4)
    for _ in range(50):
        run = rng.integers(0, 1 << 60, substring.K + substring.SPREAD - 1).astype(np.uint64)
        x, y = (np.concatenate((rng.integers(0, 1 << 60, rng.integers(0, 80)).astype(np.uint64), run, rng.integers(0, 1 << 60, rng.integers(0, 80)).astype(np.uint64))) for _ in "ab")
        assert set(substring.seeds(x)[0].tolist()) & set(substring.seeds(y)[0].tolist())


@pytest.mark.parametrize("block", [8, 64, 1 << 16])
def test_words_of_many_texts(monkeypatch, block):
    """Words and seeds of blocks of texts are those of each text."""
    import pyarrow as pa

    monkeypatch.setattr(substring, "BLOCK", block)
    rng = random.Random(5)
    parts = [" ", "\t", "a", "B", "é", "\n", "zz ", " ", "q "]
    texts = pa.array([None if rng.random() < 0.1 else "".join(rng.choices(parts, k=rng.choice((0, 1, 2, 5, 30, 80)))) for _ in range(200)])
    for column in (texts, texts.cast(pa.large_string()), texts.slice(17, 90), texts.slice(0, 0)):
        known, n = column.to_pylist(), 0
        for at, counts, words in substring.many_words(column):
            each = [substring.text_words(np.frombuffer((t or "").encode(), np.uint8)) for t in known[at : at + len(counts)]]
            assert [len(w) for w in each] == counts.tolist() and np.concatenate(each).tolist() == words.tolist()
            h, own, pos = substring.many_seeds(words, counts)
            plain = [(i, *x) for i, w in enumerate(each) for x in zip(*(z.tolist() for z in substring.seeds(w)), strict=True)]
            assert list(zip(own.tolist(), h.tolist(), pos.tolist(), strict=True)) == plain
            n += len(counts)
        assert n == len(known)


def test_ends_of_many_chains():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 2, 400), rng.integers(0, 2, 400)
    i, j = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    n = np.minimum(rng.integers(0, 70, 300), 400 - np.maximum(i, j))
    assert substring.grown(a, b, i, j, n, 1).tolist() == [substring.extend(a[x : x + k], b[y : y + k]) for x, y, k in zip(i, j, n, strict=True)]
    n = np.minimum(rng.integers(0, 70, 300), np.minimum(i, j) + 1)
    assert substring.grown(a, b, i, j, n, -1).tolist() == [substring.extend(a[x - k + 1 : x + 1][::-1], b[y - k + 1 : y + 1][::-1]) for x, y, k in zip(i, j, n, strict=True)]


@pytest.mark.parametrize("few", [2, 1000])
@pytest.mark.parametrize("kind", ["long", "string"])
@pytest.mark.parametrize("within", [False, True])
def test_shared_seeds_in_arrays(spark, monkeypatch, few, kind, within):
    """Seeds of several documents, their least holders and numbers of places: the same if those of many places go apart."""
    monkeypatch.setattr(substring, "MANY", 2)
    monkeypatch.setattr(substring, "HOT", few)
    monkeypatch.setattr(substring, "GATHER", 200)
    rng = random.Random(43)
    vocab, name = [f"v{i}" for i in range(3000)], str if kind == "string" else int
    refrain, passage = rng.choices(vocab, k=9), rng.choices(vocab, k=30)
    texts = [(name(i), " ".join(rng.choices(vocab, k=30) + refrain * rng.randrange(4) + (passage if i % 5 == 0 else []))) for i in range(8, 60)]
    ship(spark)
    docs = spark.createDataFrame(texts, f"id {kind}, text string").repartition(3)
    _, hits = substring._seed_links(docs, {"long": "bigint"}.get(kind, kind), 1, within)
    places = {}
    for i, t in texts:
        for h, pos in zip(*(x.tolist() for x in substring.seeds(substring.text_words(np.frombuffer(t.encode(), np.uint8)))), strict=True):
            places.setdefault(h, []).append((i, pos))
    want = set()
    for h, p in places.items():
        if min(p)[0] < max(p)[0] or within and len(p) > 1:
            want |= {((h ^ 1 << 63) - (1 << 63), i, pos, min(p)[0], len(p)) for i, pos in p}
    got = hits.collect()
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want) > 200
    first = {(r["h"], r["id"]): r["pos"] for r in sorted(got, key=lambda r: -r["pos"])}
    assert all(r["top"] == (first[r["h"], r["id"]] == r["pos"]) for r in got if r["n"] <= 2)


def test_passages(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(4000)]
    prose = lambda n: rng.choices(vocab, k=n)
    passage, short = prose(80), prose(30)
    fuzzy = passage.copy()
    for k in (20, 41, 63):
        fuzzy[k] = "changed"
    rows = {i: prose(200) for i in range(1, 30)}
    rows[3][50:50] = passage
    rows[9][100:100] = fuzzy
    rows[12] = [*passage, *prose(10)]
    rows[14][10:10] = short
    rows[15][90:90] = short
    rows[20] = rows[18].copy()
    rows[21] = prose(20)
    rows[22] = rows[21].copy()
    docs = [(i, " ".join(w)) for i, w in rows.items()] + [(40, None), (41, ""), (None, " ".join(passage)), (9, " ".join(rows[9])), (42, "Z " * 60_000)]
    got = substring.repeated_passages(frame(spark, docs)).collect()
    found = {(r["doc_id"], r["other_id"]): r for r in got}
    assert set(found) == {(9, 3), (12, 3), (20, 18)}
    r = found[9, 3]
    assert (r["start_word"], r["end_word"], r["other_start"], r["other_end"], r["n_common"]) == (100, 180, 50, 130, 77)
    assert found[12, 3]["similarity"] == 1.0 and found[20, 18]["is_copy"] and found[20, 18]["n_common"] == 200
    assert substring.repeated_passages(frame(spark, [])).count() == 0
    clash = frame(spark, docs).withColumn("id", F.lit(1)).withColumn("h", F.lit(1)).withColumn("pos", F.lit("x"))
    assert substring.repeated_passages(clash).count() == 3


def test_two_passages_in_a_pair_are_told_apart(spark):
    """Both texts share two passages with hundreds of other words between them."""
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(5000)]
    one, two = rng.choices(vocab, k=70), rng.choices(vocab, k=90)
    docs = [(i, " ".join([*rng.choices(vocab, k=10), *one, *rng.choices(vocab, k=150), *two])) for i in (1, 2)]
    got = sorted((r["start_word"], r["end_word"], r["similarity"]) for r in substring.repeated_passages(frame(spark, docs)).collect())
    assert got == [(10, 80, 1.0), (230, 320, 1.0)]


def test_seeds_scattered_over_earlier_documents(spark):
    """Every seed of a passage is first held by some other, earlier document."""
    rng = random.Random(13)
    vocab = [f"v{i}" for i in range(5000)]
    prose = lambda n: rng.choices(vocab, k=n)
    passage = prose(60)
    docs = [(i, " ".join([*prose(40), *passage[max(0, 5 * (i % 13) - 20) : 5 * (i % 13) + 20], *prose(40)])) for i in range(52)]
    docs += [(i, " ".join([*prose(30), *passage, *prose(30)])) for i in (60, 70, 80)]
    got = substring.repeated_passages(frame(spark, docs)).collect()
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in got) == [(70, 30, 90), (80, 30, 90)]
    assert all(60 <= r["other_id"] < r["doc_id"] for r in got)


def test_every_occurrence_is_told(spark):
    """A passage twice in a document, and once after a short quotation of its middle."""
    rng = random.Random(17)
    vocab = [f"v{i}" for i in range(5000)]
    prose = lambda n: rng.choices(vocab, k=n)
    passage = prose(70)
    docs = [(1, [*prose(30), *passage, *prose(30)]), (2, [*passage, *prose(150), *passage, *prose(20)]), (3, [*passage[20:50], *prose(150), *passage])]
    got = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in substring.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect() if r["other_id"] == 1)
    assert got == [(2, 0, 70), (2, 220, 290), (3, 180, 250)]


def test_scattered_edits_are_found(spark):
    """Passages of 60 words with 3 to 9 words changed, evenly spread: a similarity of 0.85 to 0.95."""
    rng = random.Random(19)
    vocab = [f"v{i}" for i in range(5000)]
    prose = lambda n: rng.choices(vocab, k=n)
    docs = []
    for i in range(24):
        passage, n = prose(60), 3 + i % 7
        near = [f"new{i}-{k}" if k in {60 * j // n for j in range(n)} else w for k, w in enumerate(passage)]
        docs += [(2 * i, " ".join([*prose(40), *passage, *prose(40)])), (2 * i + 1, " ".join([*prose(40), *near, *prose(40)]))]
    got = {(r["doc_id"], r["other_id"]) for r in substring.repeated_passages(frame(spark, docs)).collect()}
    assert got == {(2 * i + 1, 2 * i) for i in range(24)}


def test_alike_where_other_texts_hold_every_seed(spark):
    """Passages of 60 words, four words more in one, of which earlier texts hold each part: no pair shares a run, nor both its seeds and their least holder."""
    rng = random.Random(37)
    vocab = [f"v{i}" for i in range(5000)]
    prose = lambda n: rng.choices(vocab, k=n)
    docs, need = [], set()
    for g in range(10):
        passage = prose(60)
        parts = [passage[k : k + 12] for k in range(0, 60, 12)]
        docs += [(100 * g + k, [*prose(40), *p, *prose(40)]) for k, p in enumerate(parts)]
        docs += [(100 * g + 10, [*prose(40), *passage, *prose(40)])]
        docs += [(100 * g + 20, [*prose(40), *parts[0], *(w for p in parts[1:] for w in ("new", *p)), *prose(40)])]
        need.add((100 * g + 20, 100 * g + 10))
    got = substring.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in docs])).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} == need
    assert all(r["n_common"] >= 58 and r["similarity"] > 0.95 for r in got)


def test_exact_passages_against_brute_force(spark):
    """Every place of 50 words that stand earlier, in whatever document, is covered; documents share slices of a few passages."""
    rng = random.Random(23)
    vocab = [f"v{i}" for i in range(3000)]
    prose = lambda n: rng.choices(vocab, k=n)
    pool = [prose(rng.randrange(60, 160)) for _ in range(12)]
    docs = []
    for i in range(300):
        words = prose(rng.randrange(5, 40))
        for _ in range(rng.randrange(1, 5)):
            p = rng.choice(pool)
            n = rng.choice((14, 25, 40, 55, len(p)))
            at = rng.randrange(max(1, len(p) - n + 1))
            words += p[at : at + n] + prose(rng.randrange(5, 40))
        docs.append((i, words))
    first, need = {}, {}
    for i, w in docs:
        for j in range(len(w) - 49):
            if first.setdefault(hash(tuple(w[j : j + 50])), (i, j)) != (i, j):
                need.setdefault(i, set()).update(range(j, j + 50))
    got = {}
    rows = substring.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in docs]), within=True).collect()
    text = dict(docs)
    for r in rows:
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
        a, b = text[r["other_id"]][r["other_start"] : r["other_end"]], text[r["doc_id"]][r["start_word"] : r["end_word"]]
        assert 2 * substring.common(np.array([hash(x) for x in a]), np.array([hash(x) for x in b])) / (len(a) + len(b)) >= 0.8 and min(len(a), len(b)) >= 50
        assert r["other_id"] <= r["doc_id"]
    # a passage may be told with an earlier document that lacks a few words of it at an end
    lost = {i: s - got.get(i, set()) for i, s in need.items()}
    longest = {i: max(sum(all(j + k in s for k in range(n + 1)) for n in range(50)) for j in s) for i, s in lost.items() if s}
    assert len(need) > 150 and max(longest.values()) <= 2 * substring.K and sum(n >= substring.K for n in longest.values()) <= 0.02 * len(need)


def test_passages_of_slices_held_between(spark):
    """Documents between the two hold 14-word slices of the passage they share."""
    rng = random.Random(29)
    vocab = [f"v{i}" for i in range(5000)]
    prose = lambda n: rng.choices(vocab, k=n)
    passage = prose(60)
    docs = [(1, [*prose(40), *passage, *prose(40)])] + [(i, [*prose(40), *passage[5 * (i % 11) : 5 * (i % 11) + 14], *prose(40)]) for i in range(2, 40)]
    docs += [(50, [*prose(30), *passage, *prose(30)])]
    early = [(-i, [*prose(40), *passage[5 * (i % 11) : 5 * (i % 11) + 14], *prose(40)]) for i in range(2, 40)]
    got = substring.repeated_passages(frame(spark, [(i, " ".join(w)) for i, w in early + docs])).collect()
    assert [(r["doc_id"], r["other_id"], r["start_word"], r["end_word"]) for r in got] == [(50, 1, 30, 90)]


def test_repeats_inside_one_document(spark):
    rng = random.Random(31)
    vocab = [f"v{i}" for i in range(5000)]
    prose = lambda n: rng.choices(vocab, k=n)
    passage, refrain = prose(60), prose(7)
    docs = frame(spark, [(2, " ".join([*prose(40), *passage, *prose(100), *passage])), (3, " ".join(refrain * 9)), (4, " ".join([*prose(40), *refrain, *prose(90), *refrain]))])
    got = sorted((r["doc_id"], r["other_id"], r["start_word"], r["end_word"], r["other_start"]) for r in substring.repeated_passages(docs, within=True).collect())
    assert got[0] == (2, 2, 200, 260, 40) and {r[:2] for r in got[1:]} <= {(3, 3)}
    assert substring.repeated_passages(docs).count() == 0


# -- neighbours ------------------------------------------------------------------------


def brute_neighbours(rows, every, k):
    ok = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(i, np.array(v, np.float32).astype(float))
    out = {}
    for q, a in ok.items():
        if q % every == 0:
            s = sorted(((-float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b))), i) for i, b in ok.items() if i != q), key=lambda t: (round(t[0], 12), t[1]))
            out[q] = [(i, -x) for x, i in s[:k]]
    return out


def vectors(spark, rows):
    ship(spark)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(400)]
    same = rows[7][1]
    rows += [(1000 + i, same) for i in range(120)]
    rows += [(2000, None), (2010, [0.0] * 8), (2020, [float("nan")] * 8), (2030, [None] * 8), (2040, [1.0] * 3), (None, same), (2050, [float("inf")] + [1.0] * 7), rows[20], rows[20]]
    want = brute_neighbours(rows, 10, 5)
    for block in (4096, 32):
        monkeypatch.setattr(ann, "BLOCK", block)
        got = {}
        for r in ann.nearest(vectors(spark, [(*r, 0) for r in rows]), every=10).collect():
            got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
        assert set(got) == set(want)
        hits = sum(len({i for i, _ in got[q].values()} & {i for i, _ in want[q]}) for q in want)
        assert hits >= 0.9 * sum(map(len, want.values()))
        for q in (1000, 1010):  # ties go to the smaller id
            ids = [7, *range(1000, 1120)]
            assert [got[q][k][0] for k in range(1, 6)] == [i for i in ids if i != q][:5]
            assert all(got[q][k][1] == pytest.approx(1.0) for k in range(1, 6))


def test_few_neighbours_are_all_found(spark):
    rows = [(0, [1.0, 0.0, 0.0], 0), (1, [-1.0, 0.0, 0.0], 0), (2, [0.0, 5.0, 0.0], 0)]
    got = [(r["rank"], r["vec_id"], round(r["score"], 9)) for r in ann.nearest(vectors(spark, rows), every=50).orderBy("rank").collect()]
    assert got == [(1, 2, 0.0), (2, 1, -1.0)]
    assert ann.nearest(vectors(spark, []), every=50).count() == 0
    assert ann.nearest(vectors(spark, [(50, [1.0, 2.0], 0)]), every=50).count() == 0


def test_cosine_of_extreme_vectors(spark):
    a = np.array([[1e200, 1e200], [1e-200, 0.0], [3.0, 4.0]])
    b = np.array([[1.0, 1.0], [1e-190, 1e-190], [4.0, 3.0]])
    assert ann.cosine(a, b) == pytest.approx([1.0, np.sqrt(0.5), 0.96])
    ship(spark)
    rows = spark.createDataFrame([(0, [1e300, 1e300]), (1, [1.0, 1.0]), (2, [1.0, 1.1])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in ann.nearest(rows, every=50).orderBy("rank").collect()] == [1, 2]


def test_hadamard():
    x = np.random.default_rng(0).normal(size=(3, 16))
    h = np.array([[1.0]])
    while len(h) < 16:
        h = np.block([[h, h], [h, -h]])
    assert np.allclose(ann.hadamard(x), x @ h)
    y = ann.rotate(x, 1, 0, 42)
    assert np.allclose((y * y).sum(1), (x * x).sum(1))


def test_parallel_vectors_tie_by_id(spark):
    """Forty unequal vectors of one direction all score the same."""
    rng = np.random.default_rng(5)
    v = [float(x) for x in rng.integers(1, 9, 8)]
    rows = [(100 - i, [x * 2.0**i for x in v], 0) for i in range(40)] + [(i, [float(x) for x in rng.normal(size=8)], 0) for i in range(1, 40)]
    got = [(r["vec_id"], r["score"]) for r in ann.nearest(vectors(spark, rows), every=100).orderBy("rank").collect()]
    assert [i for i, _ in got] == [61, 62, 63, 64, 65] and len({x for _, x in got}) == 1 and got[0][1] == pytest.approx(1.0)


def test_whole_numbers_are_scored_as_doubles(spark):
    """Components beyond 2 ** 24, which float32 would round together."""
    ship(spark)
    big = (1 << 24) + 1
    rows = spark.createDataFrame([(0, [big, 1]), (2, [big - 1, 1]), (1, [big + 1, 1]), (3, [0, 1])], "vec_id long, embedding array<long>")
    want = [float(ann.cosine(np.array([[big, 1.0]]), np.array([[x, 1.0]]))[0]) for x in (big + 1, big - 1)]
    got = {r["vec_id"]: r["score"] for r in ann.nearest(rows, every=50).collect()}
    assert (got[1], got[2]) == tuple(want) and len(got) == 3


def test_shapes_and_probes():
    """About OCCUPANCY vectors a bucket at any size, probes by no more than the root or so of the buckets."""
    for n in (1, 2_000, 51_282, 600_000, 10**8, 10**10):
        axes = ann.shape_of(n, 64)
        b = np.prod([2.0 * a for a in axes])
        assert b == 128 or 0.7 < n / b / ann.OCCUPANCY < 1.5
        assert ann.probes_of(axes) <= b
    x = ann._unit(np.random.default_rng(2).normal(size=(5, 16)))
    for axes in ((16,), (16, 2), (16, 16, 4)):
        size = int(np.prod([2 * a for a in axes]))
        every = ann.buckets(x, 3, axes, size, 42)
        assert (np.sort(every, axis=1) == np.arange(size)).all()
        assert (ann.buckets(x, 3, axes, 7, 42) == every[:, :7]).all()


@pytest.mark.parametrize(("occupancy", "least"), [(128, 0.95), (4, 0.9)])
def test_recall_against_brute_force(spark, monkeypatch, occupancy, least):
    """The embeddings table, as the rule has it (one hash a table), and forced to two."""
    monkeypatch.setattr(ann, "OCCUPANCY", occupancy)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    got, hits, n = {}, 0, 0
    for r in ann.nearest(table, every=50).collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    for i in np.flatnonzero(ids % 50 == 0):
        near = x @ x[i]
        near[i] = -2
        hits += len(set(ids[np.lexsort((ids, -near))[:5]]) & set(got[ids[i]]))
        n += 5
    assert hits / n >= least

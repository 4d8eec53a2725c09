"""Language profiles, the quality classifier, TIFF, WARC and the pipeline."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from plexigraph.llm import langid, quality, queries, tiff, warc
from plexigraph.llm.common import raw_texts, ship, stash, word_bounds, word_hashes

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def crc_fold(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_registry():
    names = __spark_entry__.queries()
    assert [n for n in range(1, 11) if sum(k.startswith(f"op{n}_") for k in names) != 1] == [] and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


# -- language -------------------------------------------------------------------------


def test_languages(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op4_rank_order_langid"](spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(rows) == len(docs) and all(r["held_out"] == crc_fold(i) for i, r in rows.items())
    held = [(d["lang"], rows[d["doc_id"]]) for d in docs if rows[d["doc_id"]]["held_out"]]
    assert sum(x == r["lang_pred"] for x, r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows.values())


def test_language_edges(spark):
    ids = [i for i in range(60) if not crc_fold(i)]
    text = {"aa": "banana anna nab ", "bb": "zürich üzt ßz "}
    rows = [(i, text["aa" if n % 2 else "bb"] * 5, "aa" if n % 2 else "bb", None, None) for n, i in enumerate(ids)]
    rows += [(100, None, "aa", None, None), (101, "", None, None, None), (102, "12 !? ", "bb", None, None), (103, "banana", None, None, None), (None, "zürich ßz", None, None, None), (104, "BANANA " * 100_000, None, None, None), rows[0]]
    df = spark.createDataFrame(rows, DOCS).withColumn("gram", F.lit(1)).withColumn("id", F.lit("x"))
    got = langid.identify(df).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert (by[100], by[101], by[102], by[103], by[None], by[104]) == ("und", "und", "und", "aa", "bb", "aa")
    assert langid.identify(spark.createDataFrame([], DOCS)).count() == 0
    none = langid.identify(spark.createDataFrame([(1, "abc", None, None, None)], DOCS)).first()
    assert none["lang_pred"] == "und"


def test_predictions_are_those_of_plain_python(spark):
    """Profiles learnt and rows predicted as the query does, with lists and counters."""
    from collections import Counter

    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang").collect()]

    def grams(text):
        words = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text).split()
        s = " " + " ".join(words) + " " if words else ""
        return [c for c in s if c != " "] + [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]

    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    first = lambda counts, most: [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))[:most]]
    sums = {}
    for i, t, lang in docs:
        if t is not None and lang is not None and not crc_fold(i):
            sums.setdefault(lang, Counter()).update(grams(t))
    profiles = {lang: {g: k for k, g in enumerate(first(c, langid.PROFILE))} for lang, c in sorted(sums.items())}
    got = {r["doc_id"]: r for r in queries.QUERIES["op4_rank_order_langid"](spark, SMALL).collect()}
    most = max(map(len, profiles.values()))
    assert len(got) == len(docs)
    for i, t, _ in docs:
        own = first(Counter(grams(t or "")), langid.OWN)
        if not own:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cost = {lang: np.mean([min(abs(p[g] - k), most) if g in p else most for k, g in enumerate(own)]) / most for lang, p in profiles.items()}
        best = min(cost, key=cost.get)
        assert cost[got[i]["lang_pred"]] == pytest.approx(cost[best], abs=1e-12)
        assert got[i]["score"] == pytest.approx(1 / sum(np.exp(langid.SHARP * (cost[best] - c)) for c in cost.values()))


def test_rank_order_cost():
    """Costs as defined, over lists of n-grams in plain Python."""

    def grams(text):
        words = "".join(c.lower() if c.isalpha() else " " for c in text).split()
        s = " " + " ".join(words) + " "
        out = [c for c in s if c != " "] + [s[i : i + 2] for i in range(len(s) - 1)] + [s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " "]
        return out

    text = "Der Hund, der bellt; 12 Hunde!"
    code = lambda g: sum((1 if c == " " else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    own = langid.ngrams(np.frombuffer(text.encode(), np.uint8))
    assert sorted(own.tolist()) == sorted(code(g) for g in grams(text))
    profile = langid.ranked(own, 10)
    ranks = langid.Ranks({"x": profile, "y": profile[::-1].copy()})
    near = langid.ranked(langid.ngrams(np.frombuffer(b"der hut", np.uint8)), 300)
    for k, lang in enumerate(("x", "y")):
        listed = (profile if lang == "x" else profile[::-1]).tolist()
        want = np.mean([min(abs(listed.index(g) - i), 10) if g in listed else 10 for i, g in enumerate(near.tolist())]) / 10
        assert ranks.costs(near)[k] == pytest.approx(want)


# -- quality ----------------------------------------------------------------------------


def test_quality(spark):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op5_pu_quality"](spark, SF).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    held = [(rows[i], q) for i, q in labels.items() if crc_fold(i)]
    assert all(r["held_out"] for r, _ in held) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    assert sum(r["predicted"] == q for r, q in held) >= 0.93 * len(held)
    good = [r["score"] for r, q in held if q == 1]
    bad = [r["score"] for r, q in held if q == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_held_out_labels_do_not_matter(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    wrong = labels.withColumn("quality", F.when(langid.held_out("doc_id"), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted((r["doc_id"], r["score"]) for r in quality.score(docs, x).collect()) for x in (labels, wrong))
    assert a == b


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", None, None, None), (None, "x", None, None, None), (1, "A " * 300_000, None, None, None)], DOCS).withColumn("label", F.lit(1)).withColumn("id", F.lit("x"))
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in quality.score(docs, labels).collect()] == [0.5] * 4
    assert quality.keep_good(docs, labels).count() == 4
    assert quality.score(docs.limit(0), labels).count() == 0
    some = quality.score(docs, spark.createDataFrame([(1, 1, 0), (2, 1, 0)], labels.schema))
    assert some.count() == 4


def test_risk_is_learnt_without_negatives():
    """Two clouds; positives of one, unlabelled of both."""
    rng = np.random.default_rng(0)
    pos = rng.normal(2, 1, (400, 3))
    unl = np.concatenate((rng.normal(2, 1, (600, 3)), rng.normal(-2, 1, (400, 3))))
    model = quality.fit(pos, unl, 0.6)
    assert (model.score(rng.normal(2, 1, (300, 3))) > 0.5).mean() > 0.95
    assert (model.score(rng.normal(-2, 1, (300, 3))) < 0.5).mean() > 0.95
    assert quality.estimate_prior(pos, unl) == pytest.approx(0.6, abs=0.12)


def test_gradient_is_that_of_the_risk():
    """One step of the fit against differences of the non-negative risk, written out; and the risk falls."""
    rng = np.random.default_rng(1)
    pos, unl = rng.normal(1, 1, (60, 4)), rng.normal(0, 1, (90, 4))
    mean, spread = unl.mean(0), unl.std(0)

    def risk(model):
        z = lambda x: np.clip((x - model.mean) / model.spread, -8, 8) @ model.weights + model.bias
        loss = lambda v: np.log1p(np.exp(-v))
        return 0.4 * loss(z(pos)).mean() + max(0.0, loss(-z(unl)).mean() - 0.4 * loss(-z(pos)).mean()) + 5e-4 * (model.weights**2).sum()

    fitted = quality.fit(pos, unl, 0.4, steps=2000, rate=0.01)
    best = risk(fitted)
    assert best < risk(quality.fit(pos, unl, 0.4, steps=1))
    for k in range(5):  # no small move of any weight makes the risk much less
        for step in (0.05, -0.05):
            w = fitted.weights.copy()
            bias = fitted.bias + step * (k == 4)
            if k < 4:
                w[k] += step
            assert risk(quality.Model(mean, spread, w, bias, 0.4)) > best - 1e-3


def test_scores_are_those_of_the_model(spark):
    """The query's rows: sampled, fitted and scored again in one process."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect() if not crc_fold(r["doc_id"])}
    view = lambda t: None if t is None else np.frombuffer(t.encode(), np.uint8)
    x = {r["doc_id"]: quality.features(view(r["text"])) for r in docs}
    p, u = np.stack([x[i] for i, q in labels.items() if q == 1]), np.stack(list(x.values()))
    model = quality.fit(p, u, quality.prior_of(p, u, np.stack([x[i] for i, q in labels.items() if q == 0])))
    got = {r["doc_id"]: r["score"] for r in queries.QUERIES["op5_pu_quality"](spark, SMALL).collect()}
    assert set(got) == set(x)
    want = model.score(np.stack([x[i] for i in got]).astype(np.float64))
    assert np.abs(want - np.array(list(got.values()))).max() < 1e-3


def test_word_hashes():
    import pyarrow as pa

    texts = ["a b  a\tab", "", None, "é é é x", "w" * 9000 + " " + "w" * 9000]
    arr = pa.array(["skipped", *texts]).slice(1)
    for text, raw in zip(texts, raw_texts(arr), strict=True):
        if text is None:
            assert raw is None
            continue
        assert raw.tobytes() == text.encode()
        words = text.encode().split()
        s, e = word_bounds(raw)
        assert [raw[i:j].tobytes() for i, j in zip(s, e, strict=True)] == words
        h = word_hashes(raw, s, e).tolist()
        assert len(set(h)) == len(set(words)) and all((words[i] == words[j]) == (h[i] == h[j]) for i in range(len(h)) for j in range(len(h)))


# -- TIFF ---------------------------------------------------------------------------------


PAYLOADS = [b"\xff" * 576, bytes(range(256)) * 9, b"aab" * 192 * 300, random.Random(1).randbytes(576 * 40)]


@pytest.mark.parametrize("compression", list(tiff.ENCODE))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [0, 64])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, order):
    for payload in PAYLOADS:
        payload = payload[: len(payload) // 576 * 576]
        media = tiff.encode(payload, compression, predictor, page_rows=24, strip_rows=10, tile=tile, order=order)
        pages = list(tiff.pages(media))
        assert b"".join(p.pixels.tobytes() for p in pages) == payload
        assert [p.number for p in pages] == list(range(-(-len(payload) // 576 // 24)))


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 300, b"x" * 1000, random.Random(2).randbytes(20_000), bytes(1000) + bytes(range(256)) * 60])
def test_codecs(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_known_streams():
    """The PackBits example of the TIFF 6.0 text, and a file of 16-bit planes with predictor 3 floats."""
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    values = np.arange(12, dtype=">f4").reshape(2, 6)
    planes = values.view(np.uint8).reshape(2, 6, 4).transpose(0, 2, 1).reshape(2, 24)
    coded = np.concatenate((planes[:, :1], np.diff(planes, axis=1)), axis=1).astype(np.uint8).tobytes()
    tags = [(256, 6), (257, 2), (258, 32), (259, 1), (273, 8), (277, 1), (278, 2), (279, len(coded)), (317, 3), (339, 3)]
    at = 8 + len(coded)
    media = struct.pack("<2sHI", b"II", 42, at) + coded + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
    assert (next(tiff.pages(media)).pixels[:, :, 0] == values).all()


def test_broken_tiffs(spark):
    good = tiff.encode(b"x" * 576)
    loop = bytearray(good)
    (first,) = struct.unpack_from("<I", good, 4)
    (n,) = struct.unpack_from("<H", good, first)
    struct.pack_into("<I", loop, first + 2 + 12 * n, first)
    rows = [(1, good), (2, None), (3, b""), (4, b"II*\0\xff\xff\xff\0"), (5, bytes(loop)), (6, good[:40]), (7, good.replace(b"\x78\x01", b"\x00\x00"))]

    def changed(tag, value=None, count=None):
        """The file with another value, or number of values, of a tag."""
        out = bytearray(good)
        for i in range(n):
            if struct.unpack_from("<H", out, first + 2 + 12 * i)[0] == tag:
                if count is not None:
                    struct.pack_into("<I", out, first + 6 + 12 * i, count)
                if value is not None:
                    struct.pack_into("<I", out, first + 10 + 12 * i, value)
        return bytes(out)

    rows += [(8, changed(278, 0)), (9, changed(256, 0)), (10, changed(256, 1 << 31)), (11, changed(258, count=0)), (12, changed(273, 1 << 31)), (13, changed(279, count=0)), (14, changed(277, 0)), (15, changed(257, 0xFFFFFFFF)), (16, changed(259, 7)), (17, changed(317, 9)), (18, changed(256, count=0))]
    tiled = bytearray(tiff.encode(b"x" * 576, tile=64))
    (t,) = struct.unpack_from("<I", tiled, 4)
    for i in range(struct.unpack_from("<H", tiled, t)[0]):
        if struct.unpack_from("<H", tiled, t + 2 + 12 * i)[0] in (322, 323):
            struct.pack_into("<I", tiled, t + 10 + 12 * i, 0)
    rows.append((19, bytes(tiled)))
    two = bytearray(tiff.encode(b"x" * 576 * 2, page_rows=1))
    (t,) = struct.unpack_from("<I", two, 4)
    for i in range(struct.unpack_from("<H", two, t)[0]):
        if struct.unpack_from("<H", two, t + 2 + 12 * i)[0] == 259:
            struct.pack_into("<I", two, t + 10 + 12 * i, 7)
    rows.append((20, bytes(two)))
    names = ("page", "width", "error", "pixels", "own", "none")
    df = spark.createDataFrame(rows, "id int, media binary").withColumns({x: F.lit(x) for x in names})
    got = tiff.read_pages(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["own"]["id"], []).append(r["error"])
    assert by[1] == [None] and by[5][0] is None and by[5][1] == "directories form a loop"
    assert set(by) == {i for i, _ in rows}
    assert all(by[i][-1] for i in (2, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19))
    assert by[20] == ["compression 7", None]  # the next directory is read all the same
    assert all(r["own"][x] == x for r in got for x in names)


def test_random_damage_never_raises(spark):
    """Any change of any byte gives pages or a TiffError."""
    rng = random.Random(3)
    for media in (tiff.encode(bytes(range(256)) * 9, tiff.LZW), tiff.encode(b"ab" * 576 * 3, tiff.PACKBITS, 1, page_rows=2, tile=16), tiff.encode(b"q" * 576 * 4, order=">", page_rows=3)):
        for _ in range(400):
            bad = bytearray(media)
            for _ in range(rng.randrange(1, 4)):
                bad[rng.randrange(len(bad))] = rng.randrange(256)
            try:
                list(tiff.pages(bytes(bad)))
            except tiff.TiffError:
                pass


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_few_bits_a_sample(bits):
    """Rows of 13 samples, packed high bits first."""
    rng = random.Random(bits)
    want = [[rng.randrange(1 << bits) for _ in range(13)] for _ in range(5)]
    packed = b"".join(int("".join(f"{x:0{bits}b}" for x in row).ljust(-(-13 * bits // 8) * 8, "0"), 2).to_bytes(-(-13 * bits // 8)) for row in want)
    coded = tiff.packbits_encode(packed)
    tags = [(256, 13), (257, 5), (258, bits), (259, tiff.PACKBITS), (273, 8), (277, 1), (278, 5), (279, len(coded))]
    media = struct.pack("<2sHI", b"II", 42, 8 + len(coded)) + coded + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + bytes(4)
    assert next(tiff.pages(media)).pixels[:, :, 0].tolist() == want


def test_payload_digests(spark):
    texts = [None, "", "a", "x" * 576, "é" * 40_000, "y" * 577, "a"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS).withColumn("media", F.lit(1)).withColumn("page", F.lit(0))
    got = {r["doc_id"]: r for r in tiff.payload_digests(df).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        full = raw + b"\xff" * (max(1, -(-len(raw) // 576)) * 576 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        media = tiff.encode(full)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        counts = [full.count(bytes((v,))) for v in range(256)]
        p = [c / len(full) for c in counts]
        mean = sum(v * x for v, x in enumerate(p))
        shape, rows = f"576x{min(128, len(full) // 576)}", -(-len(full) // 576 // 128)
        parts = dict(x.split("=") for x in r["feature"].split(";"))
        assert (int(parts["pages"]), parts["shape"]) == (rows, shape)
        assert float(parts["mean"]) == pytest.approx(mean, abs=1e-4)
        assert float(parts["std"]) == pytest.approx(sum(x * (v - mean) ** 2 for v, x in enumerate(p)) ** 0.5, abs=1e-4)
        assert float(parts["entropy"]) == pytest.approx(-sum(x * np.log2(x) for x in p if x), abs=1e-4)
    assert got[2][1:] == got[6][1:] and got[0][1:] == got[1][1:]
    assert tiff.payload_digests(df.limit(0)).count() == 0


# -- WARC -----------------------------------------------------------------------------------


def test_ranges_coalesce():
    gap, most = warc.GAP, warc.READ
    assert list(warc.ranges([])) == []
    assert [m for _, _, m in warc.ranges([(0, 10), (10, 5), (16 + gap, 5)])] == [[0, 1], [2]]
    assert [m for _, _, m in warc.ranges([(0, most), (most, 5)])] == [[0], [1]]


def test_warc(spark):
    rows = [(3, "http://a/ b", "same"), (1, "u", "same"), (7, None, None), (2, "u", ""), (9, "x\r\ny", "é" * 50_000), (5, "u", "same"), (None, "u", "same"), (None, "u", "lone"), (1, "u", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("sha", F.lit(1)).withColumn("id", F.lit(2))
    folder = warc.archive_folder(df)
    index = warc.write(df, folder)
    assert index.count() == len(rows)
    got = warc.read(index, folder).collect()
    want = [("1", "response", None, 4)] * 2 + [("2", "response", None, 0), ("3", "revisit", "1", 4), ("5", "revisit", "1", 4), ("7", "revisit", "2", 0), ("9", "response", None, 100_000), (None, "response", None, 4), (None, "revisit", "1", 4)]
    assert sorted(map(str, ((r["record_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got))) == sorted(map(str, want))
    for r in got:
        if r["payload"] is not None:
            assert warc.base32_sha1(bytes(r["payload"])) == r["digest"]
    some = warc.read(index.filter("record_id = '9'"), folder).collect()
    assert len(some) == 1 and bytes(some[0]["payload"]).decode() == "é" * 50_000 and some[0]["url"] == "x%0D%0Ay"
    with pytest.raises(Exception, match="differs"):
        warc.read(index.withColumn("digest", F.lit("A" * 32)), folder).collect()
    assert warc.read(warc.write(df.limit(0), folder + "e"), folder).count() == 0
    least = warc.write(df, folder + "5", least_bytes=5)
    assert {r["record_type"] for r in warc.read(least, folder).collect()} == {"response"}


def test_warc_ids_of_any_text(spark):
    """Ids that would break a header, and one that reads like null."""
    ids = ["a\r\nWARC-Type: revisit", "null", None, "", "é%0A>", "b c", "nopage"]
    df = spark.createDataFrame([(x, "u", "same" if k < 2 else f"own {k}") for k, x in enumerate(ids)], "page_id string, url string, html string")
    folder = warc.archive_folder(df)
    got = {r["record_id"]: (r["record_type"], r["refers_to"]) for r in warc.read(warc.write(df, folder), folder).collect()}
    assert got == {x: ("response", None) for x in ids} | {"null": ("revisit", ids[0])}


# -- pipeline ---------------------------------------------------------------------------------


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stash(stage(spark, before, SMALL), "test")
        assert docs.columns == first, name
        rows, was = docs.collect(), {r["doc_id"]: r for r in before.collect()}
        if name == "quality classifier":
            scores = {r["doc_id"]: r["predicted"] for r in queries.QUERIES["op5_pu_quality"](spark, SMALL).collect()}
            assert sorted(r["doc_id"] for r in rows) == sorted(i for i, p in scores.items() if p)
        elif name == "line dedup":
            from tests.llm.test_native import brute_lines

            assert sorted((r["doc_id"], r["text"]) for r in rows) == sorted(brute_lines([(i, r["text"]) for i, r in was.items()]))
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
        elif name == "simhash near-dedup":
            from tests.llm.test_pairs import classes, jaccard, shingles

            sets = {i: shingles(r["text"]) for i, r in was.items()}
            root = classes(sorted(was), lambda a, b: jaccard(sets[a], sets[b]) >= 0.8)
            kept = {r["doc_id"] for r in rows}
            # nothing goes but for a chain of links, and hardly a link is missed
            assert kept >= set(root.values()) and len(kept - set(root.values())) <= 0.01 * len(was)
            assert not [(a, b) for a in kept for b in kept if a < b and jaccard(sets[a], sets[b]) >= 0.9]
        else:
            assert {r["doc_id"] for r in rows} <= set(was)
        if name == "mixing sources":
            from tests.llm.test_native import water

            sizes, taken, copies = {}, {}, {}
            for r in was.values():
                sizes[r["source"]] = sizes.get(r["source"], 0) + len((r["text"] or "").encode().split())
            for r in rows:
                taken[r["source"]] = taken.get(r["source"], 0) + len((r["text"] or "").encode().split())
                copies[r["doc_id"]] = copies.get(r["doc_id"], 0) + 1
                assert r == was[r["doc_id"]]
            longest = max(len((r["text"] or "").encode().split()) for r in was.values())
            assert all(abs(taken.get(s, 0) - t) <= longest for s, t in water(sizes).items()) and max(copies.values()) <= 3
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).collect()
    sums = {}
    for r in pieces:
        sums[r["doc_id"]] = sums.get(r["doc_id"], 0) + r["n_tokens"]
    want = {}
    for r in docs.collect():
        want[r["doc_id"]] = want.get(r["doc_id"], 0) + len((r["text"] or "").encode().split())
    assert sums == want
    slots = [(r["bucket_len"], r["batch"], r["slot"]) for r in pieces if r["n_tokens"]]
    assert len(set(slots)) == len(slots) and all(r["n_tokens"] <= r["bucket_len"] for r in pieces if r["n_tokens"])
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).agg(F.sum("n_tokens")).first()[0]
    assert packed == sum(len(r["text"].encode().split()) for r in docs.collect())
    assert corpus_pipeline.run(spark, SMALL).agg(F.sum("n_tokens")).first()[0] == packed


def test_stages_take_odd_tables(spark, tmp_path):
    """Nulls anywhere, empty and very long texts, repeated rows, clashing names, and no rows at all."""
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (2, "word " * 200_000, "en", None, 1), (3, "a\nb\nc", None, "s", 5), (3, "a\nb\nc", None, "s", 5), (4, "a\nb\nc", None, "t", 5), (None, "x", "en", "t", 1), (None, "x", "en", "t", 1)]
    more = {c: F.lit(i) for i, c in enumerate(("id", "key", "size", "label", "doc", "copies", "rank", "fp", "h"))}
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, None), (4, None, None)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for n in (len(rows), 0):
        docs = spark.createDataFrame(rows[:n], DOCS).withColumns(more)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stash(stage(spark, docs, str(tmp_path)), "odd")
            assert out.columns == docs.columns, name
            assert out.count() <= 3 * n
        assert (corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0) == (n > 0)

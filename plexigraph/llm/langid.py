"""Language identification by rank-order profiles (Cavnar and Trenkle, 1994).

A profile is the list of a language's most frequent character n-grams
(n = 1 to 3), in order.  A document's own list is compared to each profile: an n-gram
costs the difference of its two ranks, or a full list's length if the profile
lacks it.  The language with the least sum wins.

N-grams are 64-bit integers that hold their code points exactly, so whole
batches are counted by sorting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import column, raw_texts

#: N-grams of a language's profile, and of a document's.
PROFILE, OWN = 400, 300
#: Sharpness of the score: a softmax over mean costs.
SHARP = 20.0
#: Distinct n-grams a task holds for one language before it hands them on.
HOLD = 1 << 20
#: Salted parts in which a language's n-grams are ranked first.
PARTS = 16

_LETTERS: list[np.ndarray] = []
_GAP = 1  # stands for any run of non-letters; no letter has this code point


def _letters() -> np.ndarray:
    """Code point to lower-case letter; 0 for what is no letter."""
    if not _LETTERS:
        t = np.zeros(0x110000, np.uint32)
        for cp in range(0x110000):
            c = chr(cp)
            if c.isalpha():
                low = c.lower()
                t[cp] = ord(low) if len(low) == 1 else cp
        _LETTERS.append(t)
    return _LETTERS[0]


def ngrams(raw: np.ndarray | None) -> np.ndarray:
    """All n-grams of one to three characters of a text's words, as integers.

    Words are padded with a gap on each side; no n-gram spans a gap.
    """
    if raw is None or not len(raw):
        return np.zeros(0, np.int64)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    c = _letters()[points]
    letter = c > 0
    if not letter.any():
        return np.zeros(0, np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of each gap, its first character
    x = np.where(letter, c, _GAP)[keep].astype(np.int64)  # begins with a letter
    x = np.pad(x, (1, int(x[-1] != _GAP)), constant_values=_GAP)
    two = (x[:-1] << 21) | x[1:]
    three = (two[:-1] << 21) | x[2:]
    return np.concatenate((x[x != _GAP], two, three[x[1:-1] != _GAP]))


def ranked(codes: np.ndarray, most: int) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by their integer."""
    grams, counts = np.unique(codes, return_counts=True)
    return grams[np.argsort(-counts, kind="stable")[:most]]


def train(docs: DataFrame, text_col: str, lang_col: str, most: int = PROFILE) -> dict[str, np.ndarray]:
    """Language to its profile, from every document of ``docs`` with a language and letters.

    Tasks count the n-grams of their documents by language and hand on sums; the
    ranking cuts each of PARTS salted parts first, so that no task sees all of a language's
    n-grams.  What reaches the driver is ``most`` n-grams a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}

        def out(lang: str) -> pa.RecordBatch:
            grams, n = sums.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])

        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                new: dict[str, list[np.ndarray]] = {}
                for lang, raw in zip(column(part, "lang").to_pylist(), raw_texts(column(part, "text")), strict=True):
                    new.setdefault(lang, []).append(ngrams(raw))
                for lang, codes in new.items():
                    grams, n = np.unique(np.concatenate(codes), return_counts=True)
                    if lang in sums:
                        grams, where = np.unique(np.concatenate((sums[lang][0], grams)), return_inverse=True)
                        n = np.bincount(where, np.concatenate((sums[lang][1], n)), len(grams)).astype(np.int64)
                    sums[lang] = [grams, n]
                    if len(grams) > HOLD:
                        yield out(lang)
        for lang in list(sums):
            yield out(lang)

    usable = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    counts = usable.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = (F.col("n").desc(), F.col("gram"))
    salted = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(PARTS)))
    first = salted.withColumn("r", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).filter(F.col("r") <= most)
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best))).filter(F.col("rank") <= most)
    table = last.select("lang", "rank", "gram").toPandas()
    return {str(lang): g.sort_values("rank")["gram"].to_numpy(np.int64) for lang, g in table.groupby("lang", sort=True)}


class Ranks:
    """All profiles as one table: n-gram by language, the rank or -1."""

    def __init__(self, profiles: dict[str, np.ndarray]):
        self.langs = sorted(profiles)
        self.grams = np.unique(np.concatenate([profiles[x] for x in self.langs])) if profiles else np.zeros(0, np.int64)
        self.rank = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for i, x in enumerate(self.langs):
            self.rank[i, np.searchsorted(self.grams, profiles[x])] = np.arange(len(profiles[x]))
        self.most = max((len(p) for p in profiles.values()), default=1)

    def costs(self, own: np.ndarray) -> np.ndarray:
        """Each language's mean out-of-place cost, 0 to 1."""
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        rank = np.where(self.grams[at] == own, self.rank[:, at], -1)
        cost = np.where(rank < 0, self.most, np.minimum(np.abs(rank - np.arange(len(own))), self.most))
        return cost.mean(1) / self.most


def predict(docs: DataFrame, profiles: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score): the least-cost language of every whole text.

    ``und`` with score 0 if the text is null or has no letter, or if there is no
    profile.  Ties go to the language first in code point order.
    """
    table = Ranks(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for raw in raw_texts(column(b, "text")):
                codes = ngrams(raw)
                if not len(codes) or not table.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                cost = table.costs(ranked(codes, OWN))
                best = int(np.argmin(cost))
                langs.append(table.langs[best])
                scores.append(float(1 / np.exp(SHARP * (cost[best] - cost)).sum()))
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"])

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, lang_pred string, score double")


def held_out(id_col: str):
    """crc32 of the id as text, mod 5, is 0.  A null id counts as the empty text (held out)."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id_col, held_out, lang_pred, score) for every document.

    Profiles are learnt from the documents that are not held out and have a language.  The
    prediction reads the text alone.  Rows that repeat are each predicted; an empty
    table gives no rows.  Other columns of ``docs`` are not read.
    """
    profiles = train(docs.filter(~held_out(id_col)), text_col, lang_col)
    out = predict(docs, profiles, id_col, text_col)
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "lang_pred", "score")

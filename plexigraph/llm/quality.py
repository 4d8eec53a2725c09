"""Quality classification by positive-unlabelled learning.

A logistic model over text statistics is fitted by minimising the non-negative
unbiased risk (Kiryo et al., 2017)

    prior * E_p[loss(z)] + max(0, E_u[loss(-z)] - prior * E_p[loss(-z)])

over trusted positives p and unlabelled text u.  The class prior is that of the
unlabelled text: estimated from how a first classifier of positives against unlabelled text scores
the two (Elkan and Noto, 2008), and, if there are trusted negatives, averaged with the prior at which a classifier
of the two labels explains the unlabelled scores best (Saerens et al., 2002).  The first errs low where
positives are of many kinds, the second high where negatives are few.
Negative labels serve nothing but that estimate.

Documented bounds: the model is fitted on at most POSITIVES trusted and UNLABELLED
other rows, and the prior on NEGATIVES more, those least by a hash of their id.  Every document is scored whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import SPACE, column, raw_texts, word_bounds, word_hashes
from .langid import held_out

#: Bounds of the fitting sample (rows).
POSITIVES, UNLABELLED, NEGATIVES = 6_000, 16_000, 2_000
#: Scores from here on predict label 1.
THRESHOLD = 0.3

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_STATS = 18
SIZE = 128 + _STATS


def features(raw: np.ndarray | None) -> np.ndarray:
    """Statistics of a whole text: byte shares, and the shape of its words and lines."""
    x = np.zeros(SIZE, np.float32)
    if raw is None or not len(raw):
        return x
    n = len(raw)
    counts = np.bincount(raw, minlength=256)
    x[:128] = np.sqrt(counts[:128] / n)
    starts, ends = word_bounds(raw)
    w = len(starts)
    s = x[128:]
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum() / 2
    s[0] = 1
    s[1] = counts[65:91].sum() / max(letters, 1)
    s[2] = counts[128:].sum() / n
    s[3] = (~_ALNUM[raw] & ~SPACE[raw]).sum() / n
    s[4] = np.log1p(n) / 10
    if not w:
        return x
    size = ends - starts
    words = word_hashes(raw, starts, ends)
    known, times = np.unique(words, return_counts=True)
    share = times / w
    s[5] = np.log1p(w) / 10
    s[6] = size.mean() / 10
    s[7] = size.std() / 10
    s[8] = len(known) / w
    s[9] = share.max()
    s[10] = -(share * np.log(share)).sum() / 10
    s[11] = (words[1:] == words[:-1]).mean() if w > 1 else 0
    last, first = raw[ends - 1], raw[starts]
    s[12] = (~_ALNUM[last]).mean()
    s[13] = _UPPER[first].mean()
    s[14] = ((~_ALNUM[last]) & (~_ALNUM[raw[np.maximum(ends - 2, starts)]]) & (size > 1)).mean()
    s[15] = (_UPPER[first] & _UPPER[raw[np.minimum(starts + 1, ends - 1)]] & (size > 1)).mean()
    s[16] = (~_ALNUM[first] & (size == 1)).mean()
    bounds = np.flatnonzero(np.concatenate(([True], raw == 10, [True])))
    lines = np.diff(bounds)
    s[17] = np.log1p(lines.mean()) / 10
    return x


def featured(rows: DataFrame) -> DataFrame:
    """(id, text) to (id, x): the features as float32 bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array([features(t).tobytes() for t in raw_texts(column(b, "text"))], pa.binary())], ["id", "x"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, x binary")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -8, 8) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 800, rate: float = 0.02, decay: float = 1e-3) -> Model:
    """Minimises the non-negative risk with the logistic loss by Adam, on all rows at each step."""
    mean, spread = unlabelled.mean(0), unlabelled.std(0)
    spread = np.where(spread > 1e-6, spread, 1.0)
    p, u = (np.clip((x - mean) / spread, -8, 8).astype(np.float64) for x in (positive, unlabelled))
    w, b = np.zeros(p.shape[1]), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        # loss(z) = log(1 + exp(-z)): derivative s - 1; loss(-z): derivative s
        rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        gp, gu = prior * (sp - 1) / len(p), np.zeros(len(u))
        if rest >= 0:
            gu, gp = su / len(u), gp - prior * sp / len(p)
        else:  # the negative part is overfitted: step back on it alone
            gu, gp = -su / len(u), prior * sp / len(p)
        g = np.append(p.T @ gp + u.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - float(step[-1])
    return Model(mean, spread, w, b, prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, with no negative label known.

    A classifier of positives against unlabelled rows gives f; positives average
    f = c, and the share is the mean of f (1 - c) / (c (1 - f)) over the unlabelled, at most 1.
    """
    half = len(positive) / max(len(positive) + len(unlabelled), 1)
    if not len(positive) or not len(unlabelled):
        return 0.5
    model = _logistic(positive, unlabelled, even=False)
    c = float(model(positive).mean())
    f = model(unlabelled)
    ratio = f / np.maximum(1 - f, 1e-9) * (1 - c) / max(c, 1e-9)
    return float(np.clip(np.minimum(ratio, 1.0).mean(), 0.05, 0.99)) if half < 1 else 0.5


def shifted_prior(positive: np.ndarray, negative: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives at which a classifier of the two labels explains the unlabelled rows best, by expectation maximisation."""
    f = _logistic(positive, negative)(unlabelled)
    share = 0.5
    for _ in range(200):
        share = float((f * share / (f * share + (1 - f) * (1 - share))).mean())
        share = min(max(share, 1e-6), 1 - 1e-6)
    return share


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, negative: np.ndarray) -> float:
    """The class prior of the unlabelled rows, 0.05 to 0.99."""
    share = estimate_prior(positive, unlabelled)
    if len(negative):
        share = (share + shifted_prior(positive, negative, unlabelled)) / 2
    return float(np.clip(share, 0.05, 0.99))


def _logistic(one: np.ndarray, zero: np.ndarray, even: bool = True):
    """A logistic classifier of two sets of rows that count alike as wholes, whatever their sizes (or row by row)."""
    both = np.concatenate((one, zero)) if even else zero
    mean, spread = both.mean(0), np.maximum(both.std(0), 1e-3)
    x = np.clip((np.concatenate((one, zero)) - mean) / spread, -8, 8)
    y = np.concatenate((np.ones(len(one)), np.zeros(len(zero))))
    each = np.concatenate((np.full(len(one), 0.5 / len(one)), np.full(len(zero), 0.5 / len(zero)))) if even else np.full(len(y), 1 / len(y))
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(300):
        g = (_sigmoid(x @ w + b) - y) * each
        w, b = w - 0.5 * (x.T @ g + 1e-3 * w), b - 0.5 * g.sum()
    return lambda z: _sigmoid(np.clip((z - mean) / spread, -8, 8) @ w + b)


def _sample(docs: DataFrame, ids: DataFrame, most: int) -> np.ndarray:
    """Features of the documents with the ``most`` ids that come first by hash."""
    some = F.broadcast(ids.select(F.col("id").alias("some")).distinct().orderBy(F.xxhash64("some"), "some").limit(most))
    found = featured(docs.join(some, F.col("id") == F.col("some")).select("id", "text")).orderBy(F.xxhash64("id"), "id", "x").limit(most).toArrow()
    x = [np.frombuffer(b.as_py(), np.float32) for b in found.column("x")]
    return np.stack(x) if x else np.zeros((0, SIZE), np.float32)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Fits the model; ``docs`` has (id, text), ``labels`` (id, label) of the training fold.

    An id with contradictory labels is not trusted.  Without any trusted positive there
    is no model.
    """
    marks = labels.filter("id is not null and label is not null").groupBy("id").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low = high")
    p = _sample(docs, marks.filter("low = 1").select("id"), positives)
    u = _sample(docs, docs.select("id").filter("id is not null"), unlabelled)
    if not len(p) or not len(u):
        return None
    return fit(p, u, prior_of(p, u, _sample(docs, marks.filter("low = 0").select("id"), NEGATIVES)))


def apply(docs: DataFrame, model: Model | None) -> DataFrame:
    """(id, score) for every row of (id, text); 0.5 without a model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in raw_texts(column(b, "text"))]
            s = model.score(np.stack(x).astype(np.float64)) if model and x else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([column(b, "id"), pa.array(s, pa.float64())], ["id", "score"])

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, score double")


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(id_col, held_out, score, predicted) for every document.

    Labels are learnt only from ids that are not held out.  A null text scores as the
    empty one, which has features and so a score.  Rows that repeat an id are each scored;
    an empty table gives no rows.  Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    out = apply(rows, train(rows, marks))
    return out.select(F.col("id").alias(id_col), held_out("id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """The documents that the classifier accepts, with all their columns, of any name.

    Null and empty texts are scored as empty ones; rows that repeat are judged alike.  Without a trusted positive
    all stay.  An empty table stays empty.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    model = train(rows, marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t) for t in raw_texts(column(b, text_col))]
            good = model.score(np.stack(x).astype(np.float64)) >= threshold if model and x else np.ones(len(x), bool)
            yield b.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

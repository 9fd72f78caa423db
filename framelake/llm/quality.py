"""Operator 9: quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; all other text is unlabelled (no negative label is ever read). The class
prior is estimated by best-bin estimation: a positive-against-unlabelled classifier's score bin that holds the purest
top of the positives bounds the share of positives among the unlabelled. A linear model then minimises the
non-negative unbiased risk  pi R_p(+) + max(0, R_u(-) - pi R_p(-))  with the logistic loss, stepping back on the
second term whenever it falls below zero.

Features are read from the whole text and know no language: frequencies of character classes, of adjacent class pairs
and of repeated words and lines, on a log scale. Fitting uses bounded samples, chosen by a hash of doc_id
(MAX_POSITIVES, MAX_UNLABELLED); scoring reads everything.

Null and empty texts have no features and get the model's base score. Without any positive the score is 0.5. The prior
can't be estimated from fewer than LEAST rows in a half of either sample; it is PRIOR then, with a warning, unless the
caller gives it. On a few dozen documents the fit itself varies widely. Repeated rows score alike. Null doc_ids are
scored too but never sampled. Very long texts are read whole. An empty table gives an empty result. Extra columns are
kept; a ``score`` column in the input is replaced.
"""

from __future__ import annotations

import hashlib
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import small_batches, spread
from .words import byte_table, groups

MAX_POSITIVES, MAX_UNLABELLED = 3000, 6000
FOLDS = 5
LEAST, PRIOR = 20, 0.5
#: Character classes; a byte in none of them is 'other'.
CLASSES = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!", "?", "'\"`", "|", "#*$%&@^~=+", "()[]{}<>", "-_/\\"]
N_CLASSES = len(CLASSES) + 2
WIDTH = N_CLASSES + N_CLASSES**2 + 8
_CLASS = np.full(256, len(CLASSES) + 1, np.int32)
_CLASS[128:] = len(CLASSES)
for _i, _c in enumerate(CLASSES):
    _CLASS[list(_c.encode())] = _i
_TABLE = byte_table(words="nonspace", lower=True)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0


def features(a) -> np.ndarray:
    """(documents, WIDTH) of a group of scanned documents."""
    n = a.n_docs
    lo, hi = int(a.offs[0]), int(a.offs[-1])
    size = np.diff(a.offs)
    kind = _CLASS[a.data[lo:hi]]
    doc = np.repeat(np.arange(n, dtype=np.int32), size)
    out = np.zeros((n, WIDTH))
    one = np.bincount(doc * N_CLASSES + kind, minlength=n * N_CLASSES).reshape(n, -1)
    same = doc[1:] == doc[:-1]
    pair = (doc[1:] * N_CLASSES**2 + kind[:-1] * N_CLASSES + kind[1:])[same]
    two = np.bincount(pair, minlength=n * N_CLASSES**2).reshape(n, -1)
    length = np.maximum(size, 1)[:, None]
    out[:, :N_CLASSES], out[:, N_CLASSES : N_CLASSES + N_CLASSES**2] = one / length, two / length
    words = np.bincount(a.doc, minlength=n)
    at = np.maximum(words, 1)
    extra = out[:, N_CLASSES + N_CLASSES**2 :]
    again = (a.doc[1:] == a.doc[:-1]) & (a.hash[1:] == a.hash[:-1])
    extra[:, 0] = np.bincount(a.doc[1:][again], minlength=n) / at
    second = (a.doc[2:] == a.doc[:-2]) & (a.hash[2:] == a.hash[:-2])
    extra[:, 1] = np.bincount(a.doc[2:][second], minlength=n) / at
    order = np.lexsort((a.hash, a.doc))
    d, h = a.doc[order], a.hash[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    extra[:, 2] = (np.bincount(d[fresh], minlength=n) / at) * (words > 0)
    longest = np.zeros(n)
    np.maximum.at(longest, a.doc, (a.end - a.start).astype(float))
    extra[:, 3] = np.bincount(a.doc, (a.end - a.start).astype(float), minlength=n) / at / 20
    out = np.log1p(1000 * out) / np.log(1001)
    out[:, -4] = np.log1p(size) / 10
    out[:, -3] = np.log1p(words) / 10
    out[:, -2] = np.log1p(longest) / 10
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weight + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _descend(gradient, width: int, steps: int, rate: float) -> np.ndarray:
    """Adam on a parameter vector whose last entry is the bias."""
    w, m, v = np.zeros(width + 1), np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def _mean_gradient(x: np.ndarray, pull: np.ndarray) -> np.ndarray:
    return np.append(x.T @ pull, pull.sum()) / len(x)


def estimate_prior(p: np.ndarray, u: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """Share of positives in ``u`` by best-bin estimation on held-out halves of both (standardised features)."""
    p1, p2, u1, u2 = p[::2], p[1::2], u[::2], u[1::2]
    if min(len(p1), len(p2), len(u1), len(u2)) < LEAST:
        warnings.warn(f"too few rows to estimate the class prior: it is taken for {PRIOR}", stacklevel=2)
        return PRIOR

    def gradient(w):
        return _mean_gradient(p1, -_sigmoid(-(p1 @ w[:-1] + w[-1]))) + _mean_gradient(u1, _sigmoid(u1 @ w[:-1] + w[-1])) + 1e-3 * np.append(w[:-1], 0)

    w = _descend(gradient, p.shape[1], 150, 0.02)
    return best_bin(p2 @ w[:-1], u2 @ w[:-1], delta, gamma)


def best_bin(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, gamma: float = 0.01) -> float:
    """The share of unlabelled scores over that of positive ones from the cut on where its upper bound is least."""
    sp, su = np.sort(positive), np.sort(unlabelled)
    cuts = np.unique(sp)
    qp = 1 - np.searchsorted(sp, cuts) / len(sp)
    qu = 1 - np.searchsorted(su, cuts) / len(su)
    slack = np.sqrt(np.log(4 / delta) / 2)
    bound = (qu + slack / np.sqrt(len(su)) + (1 + gamma) * slack / np.sqrt(len(sp))) / np.maximum(qp, 1e-9)
    best = int(np.argmin(bound))
    return float(np.clip(qu[best] / qp[best], 0.05, 0.98))


def risk_gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, pi: float, decay: float = 0.0) -> np.ndarray:
    """The way down of the non-negative risk: its gradient, or away from its second term where that is below zero."""
    fp, fu = p @ w[:-1] + w[-1], u @ w[:-1] + w[-1]
    up = _mean_gradient(p, -_sigmoid(-fp)) * pi
    negative = _softplus(fu).mean() - pi * _softplus(fp).mean()
    down = _mean_gradient(u, _sigmoid(fu)) - pi * _mean_gradient(p, _sigmoid(fp))
    return (up + down if negative >= 0 else -down) + decay * np.append(w[:-1], 0)


def fit(positives: np.ndarray, unlabelled: np.ndarray, *, prior: float | None = None, steps: int = 800, rate: float = 0.1, decay: float = 1e-5) -> Model:
    """Minimises the non-negative risk; ``prior`` is estimated if not given."""
    width = WIDTH
    if not len(positives) or not len(unlabelled):
        return Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positives, unlabelled))
    pi = estimate_prior(p, u) if prior is None else prior

    w = _descend(lambda w: risk_gradient(w, p, u, pi, decay), width, steps, rate)
    return Model(mean, scale, w[:-1], float(w[-1]), pi)


def _feature_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in groups(batch.column(0), _TABLE):
            x = features(a)
            yield pa.RecordBatch.from_arrays([pa.array([r.astype(np.float32).tobytes() for r in x], pa.binary())], names=["x"])


def _matrix(texts: DataFrame) -> np.ndarray:
    rows = small_batches(texts).mapInArrow(_feature_rows, "x binary").collect()  # bounded by the sample sizes
    # In a hashed order of their own, so that a fit doesn't depend on how the rows were dealt.
    return np.array([np.frombuffer(x, np.float32) for x in sorted((bytes(r[0]) for r in rows), key=lambda x: hashlib.sha256(x).digest())], np.float64).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame, *, max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED, prior: float | None = None) -> Model:
    """Fits on documents outside the held-out fold. ``labels`` has doc_id and quality; only its 1s are read."""
    good = labels.filter((F.col("quality") == 1) & ~held_out(F.col("doc_id"))).select("doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positives)
    positives = docs.join(F.broadcast(good), "doc_id")  # at most max_positives ids; of repeated ids twice as many rows
    positives = positives.orderBy(F.xxhash64("doc_id", "text"), "doc_id").limit(2 * max_positives).select("text")
    pool = docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = 1.2 * max_unlabelled / max(1, docs.count()) * FOLDS / (FOLDS - 1)
    place = F.pmod(F.xxhash64(F.lit("unlabelled"), "doc_id"), F.lit(1 << 30))
    picked = pool.filter(place < int(min(1.0, share) * (1 << 30))).orderBy(place, "doc_id", F.xxhash64("text")).limit(max_unlabelled)
    return fit(_matrix(positives), _matrix(picked.select("text")), prior=prior)


def score_quality(docs: DataFrame, model: Model, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with score: how likely label 1 is."""
    docs = spread(small_batches(docs.drop("score")))
    fields = [f for f in docs.schema.fields if keep is None or f.name in keep]
    names = [f.name for f in fields]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # WIDTH weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            scores = [shared.value.score(features(a)) for a in groups(column, _TABLE)] or [np.zeros(0)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(np.concatenate(scores))], names=[*names, "score"])

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField("score", T.DoubleType())]))

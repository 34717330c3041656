"""Quality classifier: naive-Bayes support vectors over n-gram indicators.

Features are hashed indicators: byte n-grams of 3 and 5, words, and word pairs (equal neighbours also set one
common feature, for looping text); words are cut at ASCII white space. Each is scaled by the log ratio of its smoothed class frequencies; a machine
of the linear hinge loss is fitted by dual coordinate descent on rows of unit length; a logistic curve, fitted on
rows kept apart, turns margins into probabilities of label 1.

Fitting uses a bounded sample (``limit`` labelled rows); scoring reads every whole text. With one class only,
every text gets that class's smoothed rate. Empty texts have no features and get the score of the bias.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from .common import filter_texts, slices
from .labelled import kept_apart, release, sample, scored
from .linear import Scaled, hinge_dual, platt, sigmoid
from .wordhash import words_of

BITS = 18
LIMIT = 5_000
THRESHOLD = 0.7
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _hash(x: np.ndarray) -> np.ndarray:
    return ((x * _MULTIPLIER) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct hashed n-grams of each text."""
    out = []
    for a, b in slices(texts, 200_000):
        raws = [t.encode() for t in texts[a:b]]
        n, words = words_of(raws)
        end = np.cumsum(n)
        out += [_features(raw, words[j - m : j]) for raw, m, j in zip(raws, n.tolist(), end.tolist())]
    return out


def _features(raw: bytes, words: np.ndarray) -> np.ndarray:
    b, parts = np.frombuffer(raw, np.uint8).astype(np.uint64), [np.zeros(0, np.int32)]
    for n in (3, 5):
        if len(b) >= n:
            h = b[: len(b) - n + 1].copy()
            for k in range(1, n):
                h |= b[k : len(b) - n + 1 + k] << np.uint64(8 * k)
            parts.append(_hash(h ^ np.uint64(n << 56)))
    parts.append(_hash(words ^ np.uint64(1 << 60)))
    if len(words) > 1:
        parts.append(_hash((words[:-1] * np.uint64(31) + words[1:]) ^ np.uint64(1 << 61)))
        if (words[:-1] == words[1:]).mean() > 0.05:
            parts.append(np.zeros(1, np.int32))
    x = np.sort(np.concatenate(parts))
    new = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=new[1:])
    return x[new]


def _kernel():
    def apply(ids, texts):
        idx = features(texts)
        return {"doc_id": ids, "idx": idx, "val": [[]] * len(idx)}

    return apply


@dataclass
class Model:
    weights: np.ndarray  # already scaled by the log-count ratios
    bias: float
    slope: float
    offset: float
    ratio2: np.ndarray  # squared ratios, for the unit length of a row

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        margin = np.array([self.weights[i].sum() / max(np.sqrt(self.ratio2[i].sum()), 1e-9) if len(i) else 0.0 for i in rows])
        return sigmoid(self.slope * (margin + self.bias) + self.offset)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", limit: int = LIMIT, c: float = 1.0, alpha: float = 1.0, id_col: str = "doc_id", text_col: str = "text") -> Model:
    x, y, ids = sample(docs, labels, label_col, limit, _kernel, id_col, text_col)
    dims, apart = 1 << BITS, kept_apart(ids)  # rows for the curve
    if not apart.any() or apart.all() or len(set(y[~apart])) < 2:
        rate = (y.sum() + 1) / (len(y) + 2)
        return Model(np.zeros(dims), 0.0, 0.0, float(np.log(rate / (1 - rate))), np.ones(dims))
    t = y[~apart]
    good, bad = np.where(apart, 0, y), np.where(apart, 0, 1 - y)
    p, q = x.counts(good, dims), x.counts(bad, dims)
    seen = p + q >= 2
    p, q = p + alpha, q + alpha
    ratio = np.where(seen, np.log((p / p.sum()) / (q / q.sum())), 0.0)
    cost = np.where(t > 0, c * len(t) / (2 * t.sum()), c * len(t) / (2 * (len(t) - t.sum())))
    w, bias = hinge_dual(Scaled(x, ~apart, ratio), np.where(t > 0, 1.0, -1.0), dims, cost)
    model = Model(w * ratio, bias, 1.0, 0.0, ratio**2)
    model.slope, model.offset = platt(Scaled(x, apart, ratio).dot(w) + bias, y[apart])
    del x
    release()
    return model


def _sent(docs: DataFrame, model: Model):
    """The model of fixed size, as a broadcast variable."""
    return docs.sparkSession.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.bias, model.slope, model.offset, model.ratio2.astype(np.float32)))


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, that score the threshold or more."""
    sent = _sent(docs, model)

    def kernel():
        own = sent.value
        return lambda texts: (own.scores(features(texts)) >= threshold).tolist()

    return filter_texts(docs, kernel, text_col)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every text."""
    sent = _sent(docs, model)

    def kernel():
        own = sent.value
        return lambda ids, texts: {"doc_id": ids, "score": own.scores(features(texts)).astype(float)}

    return scored(docs, kernel, threshold, id_col, text_col)

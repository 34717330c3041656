"""Small linear learners over sparse rows, for bounded training samples on the driver."""

from __future__ import annotations

import zlib
from collections.abc import Iterable

import numpy as np


class Rows:
    """Sparse rows: column ``idx`` and ``val`` of row i at ``ptr[i]:ptr[i + 1]``. Without values all are 1."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray | None]]) -> None:
        self.ptr = np.concatenate([[0], np.cumsum([len(i) for i, _ in parts])]).astype(np.int64)
        self.n = len(parts)
        self.idx = np.empty(self.ptr[-1], np.int32)
        self.val = None if parts and parts[0][1] is None else np.empty(self.ptr[-1], np.float32)
        for k, (i, v) in enumerate(parts):
            self.idx[self.ptr[k] : self.ptr[k + 1]] = i
            if self.val is not None:
                self.val[self.ptr[k] : self.ptr[k + 1]] = v

    @classmethod
    def filled(cls, lengths: np.ndarray, idx: Iterable[np.ndarray], val: Iterable[np.ndarray] | None) -> Rows:
        """Rows of known lengths, filled in one by one."""
        own = cls([])
        own.ptr, own.n = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64), len(lengths)
        own.idx = np.empty(own.ptr[-1], np.int32)
        own.val = None if val is None else np.empty(own.ptr[-1], np.float32)
        for out, parts in ((own.idx, idx), (own.val, val or ())):
            for k, part in enumerate(parts):
                out[own.ptr[k] : own.ptr[k + 1]] = part
        return own

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray | None]:
        return self.idx[self.ptr[i] : self.ptr[i + 1]], None if self.val is None else self.val[self.ptr[i] : self.ptr[i + 1]]

    def each(self, values: np.ndarray) -> np.ndarray:
        """A value of each row, for each of its entries."""
        return np.repeat(values.astype(np.float32), np.diff(self.ptr))

    def sums(self, entries: np.ndarray) -> np.ndarray:
        """Sums of entries by row."""
        total = np.concatenate([[0.0], np.cumsum(entries, dtype=np.float64)])
        return total[self.ptr[1:]] - total[self.ptr[:-1]]

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.sums(self.val * w[self.idx])

    def back(self, r: np.ndarray, dims: int) -> np.ndarray:
        return np.bincount(self.idx, self.val * self.each(r), dims)

    def counts(self, weight: np.ndarray, dims: int) -> np.ndarray:
        """Weighted number of rows in which each column occurs (a row has a column once); row by row, without copies."""
        out = np.zeros(dims)
        for k in np.flatnonzero(weight):
            out[self.idx[self.ptr[k] : self.ptr[k + 1]]] += weight[k]
        return out


class PackedRows:
    """Indicator rows that stay compressed (differences of columns); a row is unpacked each time it is asked for."""

    def __init__(self, packed: list[bytes]) -> None:
        self.packed, self.n = packed, len(packed)

    def __getitem__(self, i: int) -> tuple[np.ndarray, None]:
        return unpacked(self.packed[i]), None

    def counts(self, weight: np.ndarray, dims: int) -> np.ndarray:
        out = np.zeros(dims)
        for k in np.flatnonzero(weight):
            out[unpacked(self.packed[k])] += weight[k]
        return out


def packed(idx: np.ndarray) -> bytes:
    """Sorted columns of a row as compressed bytes."""
    return zlib.compress(np.diff(np.asarray(idx, np.uint32), prepend=np.uint32(0)).tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), np.uint32), dtype=np.uint32).astype(np.int32)


class Scaled:
    """Chosen rows of indicators with entries scaled by column and each row of unit length, made when asked for."""

    def __init__(self, rows: Rows | PackedRows, keep: np.ndarray, scale: np.ndarray) -> None:
        self.rows, self.at, self.scale, self.n = rows, np.flatnonzero(keep), scale, int(keep.sum())

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        idx, _ = self.rows[self.at[i]]
        v = self.scale[idx]
        return idx, v / max(float(np.sqrt(v @ v)), 1e-9)

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.array([v @ w[idx] for idx, v in (self[i] for i in range(self.n))])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def hinge_dual(x: Rows | Scaled, y: np.ndarray, dims: int, c: np.ndarray, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """L2-regularised machine of the linear hinge loss by dual coordinate descent; the bias is a constant column.

    A row's dual variable stays between 0 and its cost; rows at either end whose gradient points outwards are left as they are.
    """
    w, bias, alpha = np.zeros(dims), 0.0, np.zeros(x.n)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(x.n):
            idx, val = x[i]
            g = y[i] * (val @ w[idx] + bias) - 1
            new = min(max(alpha[i] - g / (float(val @ val) + 1), 0.0), float(c[i]))
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[idx] += step * val
                bias += step
                alpha[i] = new
    return w, bias


def logistic(x: Rows, target: np.ndarray, dims: int, l2: float = 1e-3, steps: int = 200, rate: float = 0.05, bias: float = 0.0, decay: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by full-batch Adam."""
    w, m, v, b, mb, vb = np.zeros(dims), np.zeros(dims), np.zeros(dims), bias, 0.0, 0.0
    for t in range(1, steps + 1):
        r = (sigmoid(x.dot(w) + b) - target) / max(x.n, 1)
        g, gb = x.back(r, dims) + l2 * w / max(x.n, 1), float(r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        up, down = 1 - 0.9**t, 1 - 0.99**t
        w = w - rate * (m / up) / (np.sqrt(v / down) + 1e-8)
        b = b - rate * (mb / up) / (np.sqrt(vb / down) + 1e-8)
    return w, b


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve from margins to probabilities, by damped Newton steps."""
    pos, neg = float(label.sum()), float(len(label) - label.sum())
    if not len(label):
        return 1.0, 0.0
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = float(margin.std()) or 1.0
    z, a, b = margin / scale, 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        g = np.array([((p - target) * z).sum(), (p - target).sum()])
        d = p * (1 - p) + 1e-9
        h = np.array([[(d * z * z).sum() + 1e-3, (d * z).sum()], [(d * z).sum(), d.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = a - step[0], b - step[1]
    return max(a, 1e-3) / scale, b

"""Shape features of masks: alignment, radial profiles, Fourier descriptors, 152 and 426 numbers per mask.

Everything here is one mask at a time, so it runs as one kernel per row of the array form.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldloom.functions.kernels import fill_holes, label, largest

#: Groups of the 426 features by position (fixed values).
GROUPS = {
    "size": (0, 7),
    "ratio": (7, 12),
    "position": (12, 14),
    "chirality": (14, 16),
    "moments": (16, 20),
    "radial_outer": (20, 276),
    "outer_stats": (276, 286),
    "outer_fft_mag": (286, 306),
    "outer_fft_phase": (306, 346),
    "inner_stats": (346, 356),
    "inner_fft_mag": (356, 376),
    "inner_fft_phase": (376, 416),
    "thickness_stats": (416, 426),
}


@dataclass
class Aligned:
    """ANA-ALIGN: the mask in canonical pose, how far it was turned, and by how much the right and the lower half
    outweigh the others, as shares of the area."""

    mask: np.ndarray
    degrees: float
    right_excess: float
    lower_excess: float


def turned(on: np.ndarray, degrees: float) -> np.ndarray:
    """A mask turned about its centroid, which comes to the middle of the canvas; nearest source pixel."""
    h, w = on.shape
    here = complex(*(v.mean() for v in np.nonzero(on)[::-1]))
    canvas = np.arange(w)[None, :] - (w - 1) / 2 + 1j * (np.arange(h)[:, None] - (h - 1) / 2)
    source = canvas * np.exp(1j * math.radians(degrees)) + here
    x, y = np.rint(source.real).astype(int), np.rint(source.imag).astype(int)
    seen = (x >= 0) & (x < w) & (y >= 0) & (y < h)
    return seen & on[np.clip(y, 0, h - 1), np.clip(x, 0, w - 1)]


def excess(on: np.ndarray, axis: int) -> float:
    """Share of the pixels in the second half of an axis (its middle line included) less that in the first."""
    counts, n = on.sum(axis=1 - axis), on.shape[axis]
    second = np.arange(n) >= (n - 1) / 2
    return float(counts[second].sum() - counts[~second].sum()) / max(int(counts.sum()), 1)


def align(mask: np.ndarray, holes: bool = True) -> Aligned:
    """Main axis level, the heavier side to the right, centroid in the middle; rotated only, never mirrored. Empty masks are a ValueError."""
    on = largest(fill_holes(mask) if holes else mask) > 0
    if not on.any():
        raise ValueError("empty mask")
    # the main axis is half the angle of the second moment as a complex number
    points = np.nonzero(on)[1] + 1j * np.nonzero(on)[0]
    degrees = math.degrees(np.angle(((points - points.mean()) ** 2).mean()) / 2)
    level = turned(on, degrees)
    if excess(level, 1) < 0:
        degrees = (degrees + 180) % 360
        level = turned(on, degrees)
    return Aligned(level, degrees, excess(level, 1), excess(level, 0))


def polar(mask: np.ndarray, resolution: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """AGG-POLAR: largest and least radius per angle about the middle; empty angles are interpolated."""
    ys, xs = np.nonzero(mask)
    if not len(ys):
        raise ValueError("empty mask")
    h, w = mask.shape
    y = np.clip(ys + round((h - 1) / 2 - ys.mean()), 0, h - 1) - (h - 1) / 2
    x = np.clip(xs + round((w - 1) / 2 - xs.mean()), 0, w - 1) - (w - 1) / 2
    t = np.minimum(np.floor((np.arctan2(y, x) + math.pi) / (2 * math.pi) * resolution).astype(int), resolution - 1)
    r = np.hypot(x, y)
    outer, inner = np.full(resolution, -np.inf), np.full(resolution, np.inf)
    np.maximum.at(outer, t, r)
    np.minimum.at(inner, t, r)
    at = np.flatnonzero(np.isfinite(outer))
    around = np.concatenate([at - resolution, at, at + resolution])
    fill = lambda p: np.interp(np.arange(resolution), around, np.tile(p[at], 3))
    return fill(outer), fill(inner)


def stats10(r: np.ndarray) -> list[float]:
    return [float(v) for v in (r.mean(), r.std(), r.min(), r.max(), r.max() - r.min(), *np.percentile(r, [10, 25, 50, 75, 90]))]


def harmonics(r: np.ndarray, n: int, ref_max: int = 8, first: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ANA-FOURIER: magnitudes, and real and imaginary parts turned so that a low harmonic has phase 0.

    The reference is the strongest low harmonic; with ``first`` it is harmonic 1 unless that holds no more than
    this share of the low ones.
    """
    f = np.fft.rfft(r)
    n = min(n, len(f) - 1) if first is None else min(n, len(r) // 2 - 1)
    low = np.abs(f[1 : min(ref_max, n) + 1])
    k0 = 1 if first is not None and low[0] > first * max(low.sum(), np.finfo(float).eps) else 1 + int(low.argmax())
    k = np.arange(1, n + 1)
    z = f[1 : n + 1] * np.exp(-1j * k * np.angle(f[k0]) / k0) / len(r)
    return np.abs(f[1 : n + 1]) / len(r), np.stack([z.real, z.imag], axis=1).ravel()


def shape_features(mask: np.ndarray, resolution: int = 256, n: int = 20, normalize: bool = False) -> np.ndarray:
    """ANA-SHAPE: area, effective radius, statistics of three profiles, Fourier descriptors of two."""
    outer, inner = polar(mask, resolution)
    area = int((mask > 0).sum())
    radius = math.sqrt(max(area, 1) / math.pi)
    profiles = [p / radius if normalize else p for p in (outer, inner, outer - inner)]
    out = [float(area), radius]
    for p in profiles:
        out += stats10(p)
    for p in profiles[:2]:
        mag, phase = harmonics(p, n)
        out += [*mag, *phase]
    return np.array(out, np.float32)


def perimeter(on: np.ndarray) -> float:
    """Border length: straight steps 1, diagonal ones the root of 2, mixed ones the mean of both."""
    p = np.pad(on, 1)
    inner = p[1:-1, 1:-1] & p[:-2, 1:-1] & p[2:, 1:-1] & p[1:-1, :-2] & p[1:-1, 2:]
    b = np.pad((on & ~inner).astype(int), 1)
    straight = b[:-2, 1:-1] + b[2:, 1:-1] + b[1:-1, :-2] + b[1:-1, 2:]
    slanted = b[:-2, :-2] + b[:-2, 2:] + b[2:, :-2] + b[2:, 2:]
    here = b[1:-1, 1:-1] > 0
    one = (straight == 2) | (straight == 3) & (slanted < 3)
    two = (straight == 0) & (slanted == 2)
    mixed = (straight == 1) & ((slanted == 1) | (slanted == 2))
    root = math.sqrt(2)
    return float((here & one).sum() + root * (here & two).sum() + (1 + root) / 2 * (here & mixed).sum())


def convex_area(on: np.ndarray) -> float:
    """Pixels whose centre is in the convex hull of the pixel corners' midpoints (monotone chain)."""
    ys, xs = np.nonzero(on)
    pts = sorted({(x + dx, y + dy) for x, y in zip(xs.tolist(), ys.tolist()) for dx, dy in ((0.5, 0), (-0.5, 0), (0, 0.5), (0, -0.5))})

    def half(points) -> list:
        out: list = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(pts) + half(pts[::-1])
    yy, xx = np.indices(on.shape)
    inside = np.ones(on.shape, bool)
    for (xa, ya), (xb, yb) in zip(hull, hull[1:] + hull[:1]):
        inside &= (xb - xa) * (yy - ya) - (yb - ya) * (xx - xa) >= -1e-9
    return float(inside.sum())


def _slog(v: float) -> float:
    return float(np.sign(v) * np.log1p(abs(v)))


def sample_features(mask: np.ndarray, angles: int = 256, n: int = 20, smooth: int = 3) -> np.ndarray:
    """ANA-426 of an aligned mask; groups are in ``GROUPS``."""
    on = largest(fill_holes(mask)) > 0
    ys, xs = np.nonzero(on)
    if not len(ys):
        raise ValueError("empty mask")
    cx, cy, area = xs.mean(), ys.mean(), float(len(ys))
    bw, bh = float(xs.max() - xs.min() + 1), float(ys.max() - ys.min() + 1)
    dx, dy = xs - cx, ys - cy
    # axes of the ellipse of equal second moments; each pixel is a unit square
    a, b, c = (dx * dx).mean() + 1 / 12, (dy * dy).mean() + 1 / 12, (dx * dy).mean()
    root = math.sqrt(max((a - b) ** 2 / 4 + c * c, 0))
    major, minor = 4 * math.sqrt((a + b) / 2 + root), 4 * math.sqrt(max((a + b) / 2 - root, 0))
    hull, edge = convex_area(on), perimeter(on)
    part = lambda p, q: 0.0 if abs(q) < np.finfo(float).eps else p / q
    outer, inner = polar(on, angles)

    def even(r: np.ndarray) -> np.ndarray:
        return sum(np.roll(r, s) for s in range(-(smooth // 2), smooth - smooth // 2)) / smooth if smooth > 1 else r

    outer, inner = even(outer), even(inner)
    (om, op), (im, ip) = harmonics(outer, n, first=1e-3), harmonics(inner, n, first=1e-3)
    return np.concatenate([
        np.log1p([area, edge, major, minor, hull, bw, bh]),
        [part(bw, bh), part(major, minor), part(area, bw * bh), part(area, hull), part(4 * math.pi * area, edge**2)],
        [_slog(cx - (xs.min() + bw / 2)), _slog(cy - (ys.min() + bh / 2))],
        [_slog(float((xs >= cx).sum() - (xs < cx).sum())), _slog(float((ys >= cy).sum() - (ys < cy).sum()))],
        [_slog(float(v.sum())) for v in (dx**3, dy**3, dx**2 * dy, dx * dy**2)],
        np.log1p(outer), np.log1p(stats10(outer)), np.log1p(om), op,
        np.log1p(stats10(inner)), np.log1p(im), ip, np.log1p(np.maximum(stats10(outer - inner), 0)),
    ])


def _vectors(mask: DataFrame, features) -> DataFrame:
    """ANA-BATCH: ``(stem, vector)``; masks that are empty drop out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems, out = [], []
            for i, (stem, h, w) in enumerate(zip(batch.column("stem").to_pylist(), batch.column("h").to_pylist(), batch.column("w").to_pylist())):
                m = np.asarray(batch.column("data")[i].values).reshape(h, w)
                try:
                    out.append(features(align(m).mask).astype(np.float64))
                    stems.append(stem)
                except ValueError:
                    continue
            yield pa.RecordBatch.from_arrays([pa.array(stems, batch.schema.field("stem").type), pa.array(out, pa.list_(pa.float64()))], names=["stem", "vector"])

    return mask.select("stem", "h", "w", "data").mapInArrow(run, f"stem {mask.schema['stem'].dataType.simpleString()}, vector array<double>")


def shape_vectors(mask: DataFrame, resolution: int = 256, n: int = 20, normalize: bool = False) -> DataFrame:
    return _vectors(mask, lambda m: shape_features(m, resolution, n, normalize))


def sample_vectors(mask: DataFrame) -> DataFrame:
    return _vectors(mask, sample_features)


def registered(r: np.ndarray, ref: np.ndarray) -> tuple[float, np.ndarray]:
    """ANA-REGISTER: the sub-bin shift of r relative to ref, and r moved back by it."""
    n = len(r)
    corr = np.fft.irfft(np.fft.rfft(r) * np.conj(np.fft.rfft(ref)), n)
    k = int(corr.argmax())
    a, b, c = corr[k - 1], corr[k], corr[(k + 1) % n]
    shift = k + (0.0 if a - 2 * b + c == 0 else 0.5 * (a - c) / (a - 2 * b + c))
    shift = (shift + n / 2) % n - n / 2
    at = (np.arange(n) + shift) % n
    low = np.floor(at).astype(int)
    return float(shift), r[low % n] * (1 - (at - low)) + r[(low + 1) % n] * (at - low)


def n_components(mask: np.ndarray) -> int:
    return int(label(mask).max(initial=0))

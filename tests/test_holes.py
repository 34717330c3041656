"""Seeds, holes and the second decode against plain loops and a model that keeps what it is asked."""

from __future__ import annotations

import math

import numpy as np
import pytest

from fieldloom.functions import expressions as E
from fieldloom.functions import kernels as K
from fieldloom.operators import model as M


def plain_seed(colour, mask, light, color_thr, rim_px, dark_pct, dark_boost, highlight_pct, dense_win, dense_min):
    """Pixel by pixel, from the description."""
    h, w, n = colour.shape
    on = {(y, x) for y in range(h) for x in range(w) if mask[y, x]}
    before, after = rim_px // 2, rim_px - 1 - rim_px // 2
    deep = {(y, x) for y, x in on if all((y + i, x + j) in on or not (0 <= y + i < h and 0 <= x + j < w) for i in range(-before, after + 1) for j in range(-before, after + 1))}
    band = on - deep
    band = band if len(band) > 50 else on
    sample = np.array([colour[p] for p in sorted(band)])
    mean = sample.mean(axis=0)
    cov = sum(np.outer(s - mean, s - mean) for s in sample) / max(len(sample) - 1, 1) + np.eye(n)
    inverse = np.linalg.inv(cov)
    bright = colour.mean(axis=2) if light is None else light
    out = set()
    for p in on:
        d = colour[p] - mean
        seed = math.sqrt(d @ inverse @ d) > color_thr
        if dark_boost and light is not None:
            seed = seed or light[p] < np.percentile([light[q] for q in band], dark_pct)
        if highlight_pct and bright[p] > np.percentile([bright[q] for q in on], highlight_pct):
            seed = False
        if seed:
            out.add(p)
    if dense_min > 1:
        fold = lambda v, m: -v if v < 0 else 2 * (m - 1) - v if v >= m else v
        r = range(-(dense_win // 2), dense_win - dense_win // 2)
        out = {(y, x) for y, x in out if sum((fold(y + i, h), fold(x + j, w)) in out for i in r for j in r) >= dense_min}
    return out


@pytest.mark.parametrize("space", ["lab", "hsv", "rgb"])
def test_seeds(space):
    r = np.random.default_rng(2)
    frame = r.integers(90, 120, (24, 30, 3)).astype(np.uint8)
    frame[8:14, 10:18] = [20, 30, 200]
    frame[16:19, 4:9] = 255  # saturated: all at the top, none above it
    mask = np.zeros((24, 30), np.uint8)
    mask[2:22, 2:28] = 255
    colour, light = K.chroma_of(frame, space)
    assert (light is None) == (space == "rgb")
    for boost in (False, True):
        for highlight, dense in ((0, 1), (90, 1), (97, 4)):
            got = K.colour_seed(colour, mask, light, 2.0, 0.0, 5, 15, boost, highlight, 5, dense)
            assert set(zip(*map(lambda v: v.tolist(), np.nonzero(got)))) == plain_seed(colour, mask, light, 2.0, 5, 15, boost, highlight, 5, dense)
    assert not K.colour_seed(colour, mask, light, var_max=0.01).any() and not K.colour_seed(colour, 0 * mask, light).any()
    one = np.zeros_like(mask)
    one[3, 3] = 1
    assert not K.colour_seed(colour, one, light).any()


class Asked(M.BoxThreshold):
    """Decodes the whole box and keeps what it was asked; logits at half size, or none."""

    def __init__(self, logits=True):
        self.calls, self.logits = [], logits

    def decode(self, state, box, points, logits):
        self.calls.append((points, logits))
        mask = np.zeros(state.shape[:2], np.uint8)
        x0, y0, x1, y1 = map(int, box)
        mask[y0:y1, x0:x1] = 255
        return mask, 0.9, np.full((mask.shape[0] // 2, mask.shape[1] // 2), 4.0) if self.logits else None


@pytest.mark.parametrize("logits", [True, False])
def test_second_decode(logits):
    frame = np.full((60, 60, 3), 100, np.uint8)
    frame[25:35, 20:30] = [255, 0, 0]
    c, model = M.HoleConfig(hole_dark_boost=False), Asked(logits)
    labels, kept, maps = M.segmented(model, frame, [("a", (6.0, 8.0, 54.0, 52.0))], 0.0, 1, c)
    (_, first), (points, prior) = model.calls
    assert first is None and len(kept) == 1
    inner = labels[8:52, 6:54] == 0
    holes = maps["hole_grown"] > 0
    assert (holes[8:52, 6:54] == inner).all() and holes[28:32, 23:27].all() and holes.sum() < 250
    ys, xs = np.nonzero(K.erode((np.pad(np.ones((44, 48), np.uint8), ((8, 8), (6, 6)))), 15))
    assert points[0] == (xs.mean(), ys.mean(), 1) and all(p[2] == 0 and holes[int(p[1]), int(p[0])] for p in points[1:]) and len(points) > 1
    if logits:
        want = np.where(holes[::2, ::2], c.hole_logit_neg, 4.0)
        assert (prior == want).all()
    else:
        assert prior is None
    thin = Asked(logits)  # no core: no positive point
    M.segmented(thin, frame, [("a", (10.0, 23.0, 50.0, 37.0))], 0.0, 1, M.HoleConfig(hole_dark_boost=False, hole_seed_rim=3, hole_edge=False))
    assert len(thin.calls) == 2 and all(p[2] == 0 for p in thin.calls[1][0])
    plain = Asked(logits)
    M.segmented(plain, frame, [("a", (6.0, 8.0, 54.0, 52.0))], 0.0, 1, M.HoleConfig(hole_refine=False, hole_dark_boost=False))
    assert len(plain.calls) == 1


def test_holes_without_seeds():
    frame = np.full((40, 40, 3), 100, np.uint8)
    model = Asked()
    labels, kept, maps = M.segmented(model, frame, [("a", (4.0, 4.0, 36.0, 36.0))], 0.0, 1, M.HoleConfig(hole_dark_boost=False))
    assert len(model.calls) == 1 and not maps["hole_grown"].any() and (labels[4:36, 4:36] == 1).all()


def test_sizes():
    a = np.arange(35).reshape(5, 7)
    assert (K.nearest_sized(a, (10, 14)) == a.repeat(2, axis=0).repeat(2, axis=1)).all() and (K.nearest_sized(a, (5, 7)) == a).all()
    for h, w in ((5, 7), (10, 3), (1, 1), (13, 20)):
        for method in ("linear", "area"):
            wy, wx = K.resize_weights(5, h, method), K.resize_weights(7, w, method)
            assert np.allclose(wy.sum(axis=1), 1) and np.allclose(wx.sum(axis=1), 1)
            assert (K.resized(a, h, w, method) == np.floor(np.round(wy @ a @ wx.T, 9) + 0.5)).all()
    assert (K.resized(np.stack([a, 2 * a], axis=2), 3, 4, "area")[..., 1] == K.resized(2 * a, 3, 4, "area")).all()
    assert (K.resized(a, 5, 7) == a).all()
    with pytest.raises(ValueError):
        K.resized(a, 2, 2, "cubic")


def test_lab_there_and_back(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(a, b) for a in range(96, 161, 8) for b in range(96, 161, 8)], "a int, b int")
    back = rows.select("a", "b", *[c.alias(n) for c, n in zip(E.lab_ab_to_bgr(F.col("a"), F.col("b")), "xyz")])
    again = back.select("a", "b", "x", "y", "z", *[c.alias(n) for c, n in zip(E.bgr_to_lab_ab(F.col("x"), F.col("y"), F.col("z")), "pq")]).collect()
    inside = [r for r in again if 0 < min(r.x, r.y, r.z) and max(r.x, r.y, r.z) < 255]
    assert len(inside) > 50 and all(abs(r.a - r.p) <= 1 and abs(r.b - r.q) <= 1 for r in inside)
    grey = next(r for r in again if r.a == r.b == 128)
    assert grey.x == grey.y == grey.z
    cut = rows.limit(1).select(*E.lab_ab_to_bgr(F.lit(255), F.lit(0))).first()
    assert all(0 <= v <= 255 for v in cut)


class Prompted(Asked):
    """Keeps the prompt, finds nothing in boxes that begin at 0, and nothing the second time."""

    def encode(self, frame, text=None, conf=0.5):
        self.prompt = text, conf
        return super().encode(frame)

    def decode(self, state, box, points, logits):
        return None if box[0] == 0 or points else super().decode(state, box, points, logits)


def test_prompts_and_models_that_find_nothing(spark):
    frame = np.full((60, 60, 3), 100, np.uint8)
    frame[25:35, 20:30] = [255, 0, 0]
    model = Prompted()
    labels, kept, maps = M.segmented(model, frame, [("a", (0.0, 8.0, 54.0, 52.0)), ("b", (6.0, 8.0, 54.0, 52.0)), ("c", None)], 0.25, 1, M.HoleConfig(hole_dark_boost=False), "only the body")
    assert model.prompt == ("only the body", 0.25) and [k for k, _ in kept] == ["b"] and (labels[28:32, 23:27] == 0).all() and labels[10, 10] == 1
    M.segmented(model, frame, [], 0.5, 1, None)
    assert model.prompt == (None, 0.5)
    labels, kept, maps = M.segmented(model, frame, [("b", (6.0, 8.0, 54.0, 52.0))], 0.95, 1, M.HoleConfig())
    assert not kept and not maps["seg_raw"].any()  # below the confidence nothing is carved

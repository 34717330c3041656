from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fieldloom.functions import codecs
from fieldloom.functions import kernels as K
from fieldloom.operators import shape as S

masks = st.integers(0, 2**36 - 1).map(lambda n: np.array([n >> i & 1 for i in range(36)], np.uint8).reshape(6, 6))


def flood(mask, eight=True):
    seen, out, n = np.zeros(mask.shape, bool), np.zeros(mask.shape, int), 0
    near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
    for y, x in zip(*np.nonzero(mask)):
        if seen[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        seen[y, x] = True
        while todo:
            p = todo.pop()
            out[p] = n
            for dy, dx in near:
                q = (p[0] + dy, p[1] + dx)
                if 0 <= q[0] < mask.shape[0] and 0 <= q[1] < mask.shape[1] and mask[q] and not seen[q]:
                    seen[q] = True
                    todo.append(q)
    return out


@settings(max_examples=150, deadline=None)
@given(masks)
def test_label_is_flood_fill(m):
    assert (K.label(m) == flood(m)).all()
    assert (K.label(m, eight=False) == flood(m, eight=False)).all()


@settings(max_examples=100, deadline=None)
@given(masks, st.integers(1, 5))
def test_morphology(m, size):
    closed, opened = K.closing(m, size), K.opening(m, size)
    if size % 2:
        assert (closed >= m).all() and (opened <= m).all()
        assert (K.closing(closed, size) == closed).all() and (K.opening(opened, size) == opened).all()
    want = np.zeros_like(m)
    back, ahead = size // 2, size - 1 - size // 2
    for y in range(6):
        for x in range(6):
            want[y, x] = m[max(0, y - back) : y + ahead + 1, max(0, x - back) : x + ahead + 1].max()
    assert (K.dilate(m, size) == want).all()


@settings(max_examples=100, deadline=None)
@given(masks)
def test_run_lengths(m):
    counts = codecs.rle_counts(m)
    assert sum(counts) == 36 and (codecs.rle_mask(counts, 6, 6) == m).all()
    assert codecs.coco_counts(codecs.coco_string(counts)) == counts


def test_holes_and_outline():
    ring = np.zeros((9, 9), np.uint8)
    ring[2:7, 2:7] = 255
    ring[4, 4] = 0
    assert K.fill_holes(ring)[4, 4] == 255
    assert K.fill_contours(ring)[4, 4] == 255
    assert K.outline_area(ring) == 16.0  # polygon through pixel centres of a 5 x 5 square
    assert not K.fill_contours(ring, low=17).any()


def test_corner_touch_and_largest():
    m = np.zeros((6, 6), np.uint8)
    m[0:2, 0:2] = m[2:4, 2:4] = 1
    assert K.label(m).max() == 1 and K.label(m, eight=False).max() == 2
    m[5, 0] = 1
    assert K.largest(m).sum() == 8 and K.by_area(m, 2).sum() == 8 and (K.by_area(m) == m).all()


def test_split_merges_near_boxes():
    m = np.zeros((10, 10), np.uint8)
    m[1:3, 1:3] = m[1:3, 5:7] = m[7:9, 7:9] = 255
    seg, boxes = K.split(m, min_area=1, merge_gap=4.5)
    assert seg.max() == 2 and boxes[0] == (1.0, 1.0, 7.0, 3.0)
    _, scaled = K.split(m, min_area=1, bbox_gap=1.0)
    assert scaled[0] == (0.0, 0.0, 4.0, 4.0)
    assert K.split(m, min_area=99)[1] == []


def test_hysteresis():
    d = np.array([[5.0, 3, 0, 3], [0, 0, 0, 0]])
    assert (K.hysteresis(d, 4, 2) > 0).tolist() == [[True, True, False, False], [False] * 4]
    assert (K.hysteresis(d, 4, None) > 0).sum() == 1


def test_canny_finds_a_step():
    a = np.zeros((12, 12))
    a[:, 6:] = 255
    e = K.canny(a)
    assert e.any() and set(np.nonzero(e)[1]) <= {5, 6}
    assert not K.canny(np.full((12, 12), 9.0)).any()


def test_points_and_seed():
    m = np.ones((2, 3), np.uint8)
    assert K.spread_points(m, 3) == [(0, 0), (2, 0), (2, 1)]
    frame = np.full((20, 20, 1), 100.0)
    frame[8:11, 8:11] = 250
    seed = K.colour_seed(frame, np.ones((20, 20)), frame[..., 0], rim_px=3)
    assert seed[9, 9] and seed.sum() == 9 * 255


@pytest.mark.parametrize("shape", [(5, 7), (4, 3, 3), (3, 4, 4)])
def test_png(shape):
    a = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    assert (codecs.png_decode(codecs.png_encode(a)) == a).all()
    with pytest.raises(ValueError):
        codecs.png_decode(b"\xff\xd8 no png")


def test_png_filters():
    import struct
    import zlib

    rows = bytes([1, 10, 5, 5, 2, 1, 1, 1, 3, 4, 4, 4, 4, 1, 2, 3])
    chunk = lambda t, b: struct.pack(">I", len(b)) + t + b + struct.pack(">I", zlib.crc32(t + b))
    data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 4, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    assert codecs.png_decode(data).tolist() == [[10, 15, 20], [11, 16, 21], [9, 16, 22], [10, 18, 25]]


def test_npy():
    a = np.array([1.0, 2.0, 3.0])
    assert (codecs.npy_decode(codecs.npy_encode(a)) == a).all()


def test_align_and_mirror():
    m = np.zeros((80, 80), np.uint8)
    m[36:44, 16:66] = 1
    m[20:44, 56:66] = 1
    a, b = S.align(m), S.align(m[:, ::-1])
    assert a.right_excess >= 0 and b.right_excess >= 0
    assert a.lower_excess * b.lower_excess < 0  # mirror images differ in the sign of chirality
    turned = S.align(np.rot90(m))
    assert (turned.mask & a.mask).sum() / (turned.mask | a.mask).sum() > 0.8
    with pytest.raises(ValueError):
        S.align(np.zeros((5, 5)))


def test_feature_sizes():
    m = np.zeros((33, 33), np.uint8)
    yy, xx = np.indices(m.shape)
    m[(yy - 16) ** 2 + (xx - 16) ** 2 <= 100] = 1
    assert S.shape_features(m).shape == (152,) and S.sample_features(m).shape == (426,)
    outer, _ = S.polar(m, 64)
    assert np.allclose(outer, 10, atol=1.0)
    assert 0.9 < S.sample_features(m)[11] < 1.2  # circularity of a disc


def test_registration_sign():
    r = np.sin(np.arange(64) / 64 * 2 * np.pi) + 0.3 * np.cos(np.arange(64) / 64 * 6 * np.pi)
    shift, back = S.registered(np.roll(r, 5), r)
    assert abs(shift - 5) < 0.05 and np.allclose(back, r, atol=0.02)


def test_boxes_and_fills_of_many():
    """Boxes of all labels at once, and components filled in their own boxes, one inside another too."""
    r = np.random.default_rng(8)
    m = (r.random((40, 50)) < 0.3).astype(np.uint8)
    m[5:30, 5:30] = 0
    m[6, 6:29] = m[28, 6:29] = m[6:29, 6] = m[6:29, 28] = 1
    m[10, 10:20] = m[19, 10:20] = m[10:20, 10] = m[10:20, 19] = 1
    own = K.label(m)
    boxes = K.boxes_of(own)
    for k in range(1, own.max() + 1):
        ys, xs = np.nonzero(own == k)
        assert boxes[k - 1].tolist() == [ys.min(), xs.min(), ys.max() + 1, xs.max() + 1]
    assert K.boxes_of(np.zeros((3, 3), int)).shape == (0, 4)
    for low, high in ((0, 0), (5, 0), (2, 100)):
        want = np.zeros_like(m)
        for k in range(1, own.max() + 1):  # on the whole frame, one by one
            solid = K.filled(own == k)[1:-1, 1:-1]
            area = K.outline_area(own == k)
            if area >= low and (not high or area <= high):
                want[solid] = 255
        assert (K.fill_contours(m, low, high) == want).all()


def test_canny_pixel_by_pixel():
    """Edges against loops over one frame: slopes by neighbours, ridges along the slope, and a walk from strong to weak ones."""
    r = np.random.default_rng(3)
    a = r.integers(0, 60, (24, 28)).astype(float)
    a[6:18, 8:20] += 150
    h, w = a.shape
    at = lambda y, x: a[min(max(y, 0), h - 1), min(max(x, 0), w - 1)]
    gx, gy = np.zeros_like(a), np.zeros_like(a)
    for y in range(h):
        for x in range(w):
            gx[y, x] = sum(k * (at(y + j, x + 1) - at(y + j, x - 1)) for j, k in ((-1, 1), (0, 2), (1, 1)))
            gy[y, x] = sum(k * (at(y + 1, x + i) - at(y - 1, x + i)) for i, k in ((-1, 1), (0, 2), (1, 1)))
    mag = abs(gx) + abs(gy)
    m = lambda y, x: mag[y, x] if 0 <= y < h and 0 <= x < w else 0
    thin = {}
    for y in range(h):
        for x in range(w):
            u, v = gx[y, x], gy[y, x]
            if abs(v) < 0.4142135 * abs(u):
                step = (0, 1)
            elif abs(v) > 2.4142135 * abs(u):
                step = (1, 0)
            else:
                step = (1, 1) if u * v > 0 else (1, -1)
            if mag[y, x] > m(y - step[0], x - step[1]) and mag[y, x] >= m(y + step[0], x + step[1]):
                thin[y, x] = mag[y, x]
    for low, high in ((100, 300), (200, 700)):
        todo = [p for p, v in thin.items() if v > high]
        seen = set(todo)
        while todo:
            y, x = todo.pop()
            for q in ((y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if q not in seen and thin.get(q, 0) > low:
                    seen.add(q)
                    todo.append(q)
        got = K.canny(a, low, high, 0)
        assert set(zip(*(v.tolist() for v in np.nonzero(got)))) == seen and len(seen) > 20

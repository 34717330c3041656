"""Model-backed segmentation. A backend is built once per Python worker; the one shipped is a deterministic stub.

Backends follow :class:`Backend`: one ``encode`` per frame, one ``decode`` per box.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import kernels as K


class Backend(Protocol):
    def encode(self, frame: np.ndarray, text: str | None = None, conf: float = 0.5) -> object:
        """The frame's state; ``text`` is a prompt that holds for all its boxes."""
        ...

    def decode(self, state: object, box: tuple[float, float, float, float], points: list[tuple[float, float, int]], logits: np.ndarray | None) -> tuple[np.ndarray, float, np.ndarray | None] | None:
        """Mask, score and logits (of any size, or none); None where the model finds nothing. Points are (x, y, 1 or 0)."""
        ...


class BoxThreshold:
    """MDL-BACKEND stub: pixels of a box that are brighter than its mean; negative points switch off their surroundings."""

    def __init__(self, reach: int = 1) -> None:
        self.reach = reach

    def encode(self, frame, text=None, conf=0.5):
        return frame.astype(float)

    def decode(self, state, box, points, logits):
        h, w = state.shape[:2]
        x0, y0, x1, y1 = (int(np.rint(v)) for v in box)
        x0, y0, x1, y1 = max(x0, 0), max(y0, 0), min(x1, w), min(y1, h)
        out = np.full(state.shape, -1.0)
        part = state[y0:y1, x0:x1]
        if part.size:
            out[y0:y1, x0:x1] = (part - part.mean()) / 255
        if logits is not None:
            out = np.minimum(out, np.maximum(K.nearest_sized(logits, out.shape), -1))
        for x, y, positive in ((round(x), round(y), on) for x, y, on in points):
            if not positive:
                out[max(y - self.reach, 0) : y + self.reach + 1, max(x - self.reach, 0) : x + self.reach + 1] = -1
        mask = (out > 0).astype(np.uint8) * 255
        return mask, float(0.5 + mask.astype(bool).mean() / 2), out


_BUILT: dict[str, Backend] = {}


def backend(spec: str, build: Callable[[], Backend]) -> Backend:
    """One instance per worker and spec."""
    if spec not in _BUILT:
        _BUILT[spec] = build()
    return _BUILT[spec]


#: Backends that a config can name; :func:`register_backend` adds to them.
BACKENDS: dict[str, Callable[..., Backend]] = {"stub": BoxThreshold}


def register_backend(kind: str, build: Callable[..., Backend]) -> None:
    BACKENDS[kind] = build


def configured(spec: dict | Callable[[], Backend] | None) -> tuple[str, Callable[[], Backend]]:
    """Name and builder of a backend: a callable, ``{"type": kind, ...arguments}``, or none for the stub."""
    if callable(spec):
        return spec.__name__, spec
    spec = dict(spec or {"type": "stub"})
    kind = spec.pop("type")
    if kind not in BACKENDS:
        raise KeyError(f"no model backend {kind}; register_backend adds one")
    return f"{kind}{sorted(spec.items())}", lambda: BACKENDS[kind](**spec)


@dataclass(frozen=True)
class HoleConfig:
    """How holes are found, grown and carved; the fields are those of the step ``segment_with_hole``."""

    preserve_holes: bool = True
    hole_refine: bool = True
    hole_debug: bool = False
    # colour seeds
    hole_space: str = "lab"
    hole_dark_boost: bool = True
    hole_highlight_pct: float = 0.0
    hole_seed_dense_win: int = 5
    hole_seed_dense_min: int = 1
    hole_color_thr: float = 3.0
    hole_seed_var_max: float = 0.0
    hole_seed_rim: int = 7
    hole_dark_pct: float = 15.0
    hole_open_size: int = 5
    # growth up to edges
    hole_edge: bool = True
    hole_edge_low: float = 50
    hole_edge_high: float = 150
    hole_edge_blur: int = 3
    hole_edge_gray: bool = True
    hole_edge_margin: int = 3
    hole_edge_close: int = 5
    hole_edge_thick: int = 3
    hole_grow_iter: int = 12
    # second decode
    hole_neg_pts_area_frac: float = 0.01
    hole_max_pts: int = 6
    hole_logit_neg: float = -6.0


#: Erosion that leaves the core of a mask, where its positive point is.
CORE = 15


@dataclass
class Carved:
    """The mask without its holes, the seeds, and the holes."""

    mask: np.ndarray
    seed: np.ndarray
    holes: np.ndarray


def hole_edges(frame: np.ndarray, c: HoleConfig) -> np.ndarray:
    return K.detect_edge(frame, c.hole_edge_low, c.hole_edge_high, c.hole_edge_blur, c.hole_edge_gray)


def hole_points(mask: np.ndarray, holes: np.ndarray, c: HoleConfig) -> list[tuple[float, float, int]]:
    """Negative points: some on every hole, more on large ones, as shares of the mask's area."""
    own, share, out = K.label(holes), max(1, int(c.hole_neg_pts_area_frac * max(1, np.count_nonzero(mask)))), []
    for k, area in enumerate(np.bincount(own.ravel())[1:], 1):
        out += [(float(x), float(y), 0) for x, y in K.spread_points(own == k, min(c.hole_max_pts, 1 + int(area) // share))]
    return out


def core_point(mask: np.ndarray) -> list[tuple[float, float, int]]:
    """The positive point: the centroid of the mask's core, if it has one."""
    ys, xs = np.nonzero(K.erode((mask > 0).astype(np.uint8), CORE))
    return [(float(xs.mean()), float(ys.mean()), 1)] if len(ys) else []


def carve_holes(model: Backend, state: object, frame: np.ndarray, edge: np.ndarray, box: tuple, mask: np.ndarray, logits: np.ndarray | None, c: HoleConfig = HoleConfig()) -> Carved:
    """MDL-HOLE: colour seeds grown into holes up to the frame's edges, negative points on them, a second decode, and the holes carved out.

    The second decode gets the first one's logits, whatever their size, with the holes' places at ``hole_logit_neg``; none if the model gave none.
    """
    chroma, light = K.chroma_of(frame, c.hole_space)
    seed = K.colour_seed(chroma, mask, light, c.hole_color_thr, c.hole_seed_var_max, c.hole_seed_rim, c.hole_dark_pct, c.hole_dark_boost, c.hole_highlight_pct, c.hole_seed_dense_win, c.hole_seed_dense_min)
    grown = K.grow(mask, seed, edge, c.hole_edge_margin, c.hole_edge_close, c.hole_edge_thick, c.hole_grow_iter) if c.hole_edge else seed
    holes = K.finalize(grown, seed, c.hole_open_size)
    points = hole_points(mask, holes, c)
    if points and c.hole_refine:
        prior = None if logits is None else np.where(K.nearest_sized(holes, logits.shape[-2:]) > 0, c.hole_logit_neg, logits)
        again = model.decode(state, box, core_point(mask) + points, prior)
        mask = mask if again is None else again[0]
    return Carved(np.where(holes > 0, 0, mask).astype(np.uint8), seed, holes)


def segmented(model: Backend, frame: np.ndarray, objects: list[tuple], conf: float, min_area: int, holes: HoleConfig | None, text: str = "") -> tuple[np.ndarray, list[tuple], dict[str, np.ndarray]]:
    """Label map, kept objects ``(class_id, box)`` and, with holes, the maps in between, of one frame; one encode, one decode per box."""
    shape = frame.shape[:2]
    state, labels, kept = model.encode(frame, text or None, conf), np.zeros(shape, np.int32), []
    maps = {n: np.zeros(shape, np.uint8) for n in ("seg_raw", "hole_seed", "hole_grown", "hole_edge")} if holes else {}
    if holes and holes.preserve_holes and holes.hole_edge:
        maps["hole_edge"] = hole_edges(frame, holes)
    for class_id, box in objects:
        if box is None:
            continue
        found = model.decode(state, box, [], None)
        if found is None or found[1] < conf:
            continue
        mask, _, logits = found
        if holes and holes.preserve_holes and mask.any():
            maps["seg_raw"][mask > 0] = 255
            carved = carve_holes(model, state, frame, maps["hole_edge"], box, mask, logits, holes)
            mask = carved.mask
            maps["hole_seed"][carved.seed > 0] = 255
            maps["hole_grown"][carved.holes > 0] = 255
        if (mask > 0).sum() < max(min_area, 1):
            continue
        ys, xs = np.nonzero(mask)
        labels[mask > 0] = len(kept) + 1
        kept.append((class_id, (float(xs.min()), float(ys.min()), float(xs.max() + 1), float(ys.max() + 1))))
    return labels, kept, maps


def segment(frames: DataFrame, objects: DataFrame, build: Callable[[], Backend], spec: str = "stub", conf: float = 0.5, min_area: int = 200, holes: HoleConfig | None = None, text: str = "") -> DataFrame:
    """MDL-SEG: ``(stem, obj_id, class_id, x0, y0, x1, y1)``, one row per object that is kept.

    One encode per frame and one decode per box; objects below ``conf`` or ``min_area`` are dropped, the rest
    renumbered from 0 with the box of their mask. An item's objects come to
    its frame as one array.
    """
    boxes = objects.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("obj_id", "class_id", "bbox"))).alias("objects"))
    rows = frames.select("stem", "h", "w", "data").join(boxes, "stem")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = backend(spec, build)
        for batch in batches:
            out = [[] for _ in range(7)]
            cols = {n: batch.column(n) for n in batch.schema.names}
            for i, stem in enumerate(cols["stem"].to_pylist()):
                h, w = cols["h"][i].as_py(), cols["w"][i].as_py()
                frame = np.asarray(cols["data"][i].values).reshape(h, w)
                listed = [(o["class_id"], tuple(o["bbox"][k] for k in ("x0", "y0", "x1", "y1"))) for o in cols["objects"][i].as_py()]
                _, kept, _ = segmented(model, frame, listed, conf, min_area, holes, text)
                for n, (class_id, box) in enumerate(kept):
                    for column, v in zip(out, (stem, n, class_id, *box)):
                        column.append(v)
            kinds = [batch.schema.field("stem").type, pa.int32(), pa.string(), *[pa.float64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["stem", "obj_id", "class_id", "x0", "y0", "x1", "y1"])

    kind = frames.schema["stem"].dataType.simpleString()
    return rows.mapInArrow(run, f"stem {kind}, obj_id int, class_id string, x0 double, y0 double, x1 double, y1 double")

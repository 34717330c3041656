"""The flow engine: config-described chains of operators over items, planned as DataFrame transforms.

A flow names its unit (frame or object), its steps, shared config, carried accumulators and finalize steps.
Building checks every name; running plans one DataFrame per context. Each step adds columns to the rows of the
units that survive; a step drops the units for which it has nothing, so later steps don't see them, while what
earlier steps had declared as output stays. Accumulators are aggregations over all units.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from fieldloom.functions import expressions as E
from fieldloom.functions import kernels
from fieldloom.operators import raster as R
from fieldloom.operators import regions as G
from fieldloom.operators.catalog import MODIFIED
from fieldloom.operators.model import HoleConfig

OPERATORS: dict[str, type[Operator]] = {}


class Operator:
    """A step. ``inputs`` and ``outputs`` are its ports, ``defaults`` its config; ``plan`` adds the output columns."""

    inputs: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ()
    defaults: dict[str, Any] = {}

    def __init__(self, **config: Any) -> None:
        unknown = set(config) - set(self.defaults)
        if unknown:
            raise KeyError(f"{type(self).__name__}: unknown config {sorted(unknown)}")
        self.config = self.defaults | config
        self.slots: dict[str, str] = {}
        self.aliases: dict[str, str] = {}

    def __init_subclass__(cls, name: str, **kw: Any) -> None:
        super().__init_subclass__(**kw)
        if name in OPERATORS:
            raise KeyError(f"operator {name} exists")
        OPERATORS[name] = cls

    def source(self, port: str) -> str:
        return self.aliases.get(port, port)

    def target(self, port: str) -> str:
        return self.slots.get(port, port)

    def plan(self, units: DataFrame) -> DataFrame:
        raise NotImplementedError


def named(units: DataFrame, target: str) -> DataFrame:
    """The kernel's raster ``data`` under its own name, in place of what had it."""
    return units.drop(target).withColumnRenamed("data", target)


class ThresholdScore(Operator, name="threshold_score"):
    inputs, outputs = ("dist",), ("mask",)
    defaults = {"k": 1.2, "k_weak": None, "invert": False, "min_area": 0, "max_area": 0, "roi": None}

    def plan(self, units):
        c = self.config
        moved = units.withColumn("data", F.col(self.source("dist")))
        out = G.threshold(moved, c["k"], c["k_weak"], c["invert"], c["min_area"], c["max_area"], c["roi"])
        return named(out, self.target("mask"))


class MaskBox(Operator, name="mask_box"):
    inputs, outputs = ("mask",), ("bbox",)

    def plan(self, units):
        m, w = F.col(self.source("mask")), F.col("w")
        at = F.filter(F.transform(m, lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
        xs, ys = F.transform(at, lambda i: i % w), F.transform(at, lambda i: F.floor(i / w).cast("int"))
        box = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), (F.array_max(xs) + 1).alias("x1"), (F.array_max(ys) + 1).alias("y1"))
        return units.withColumn(self.target("bbox"), box)


class BoxArea(Operator, name="box_area"):
    inputs, outputs = ("mask", "bbox"), ("area",)

    def plan(self, units):
        m, b, w = F.col(self.source("mask")), F.col(self.source("bbox")), F.col("w")
        x, y = (lambda i: i % w), (lambda i: F.floor(i / w))
        inside = lambda v, i: F.when((v > 0) & (x(i) >= F.rint(b["x0"])) & (x(i) < F.rint(b["x1"])) & (y(i) >= F.rint(b["y0"])) & (y(i) < F.rint(b["y1"])), 1).otherwise(0)
        return units.withColumn(self.target("area"), F.aggregate(F.transform(m, inside), F.lit(0), lambda a, v: a + v))


class ArrayKernel(Operator, name="array_kernel"):
    """Base of steps that are one NumPy kernel over one raster."""

    inputs, outputs = ("image",), ("image",)
    kernel: Callable | None = None

    def plan(self, units):
        own = self.made()
        moved = units.withColumn("data", F.col(self.source(self.inputs[0])).cast("array<int>"))
        return named(G.map_arrays(moved, ["data"], own), self.target(self.outputs[0]))

    def made(self):
        raise NotImplementedError


class DetectEdge(ArrayKernel, name="detect_edge"):
    """NB-CANNY of grey frames, or of BGR ones (``h * w * 3`` values) on their grey or per channel."""

    inputs, outputs, defaults = ("frame",), ("edge",), {"low": 50, "high": 150, "blur": 3, "gray": True}

    def plan(self, units):
        frame, target, c = self.source("frame"), self.target("edge"), dict(self.config)

        def kernel(row):
            edge = kernels.detect_edge(picture(row[frame], row["h"], row["w"]), **c)
            return {target: edge.ravel().tolist()} if edge.any() else None

        return mapped(units, {target: "array<int>"}, kernel)


class CloseEdge(ArrayKernel, name="close_edge"):
    inputs, outputs, defaults = ("edge",), ("edge",), {"size": 5}

    def made(self):
        from fieldloom.functions.kernels import closing

        size = self.config["size"]
        return lambda a: closing(a, size)


class FillEdge(ArrayKernel, name="fill_edge"):
    inputs, outputs, defaults = ("edge",), ("mask",), {"min_area": 0, "max_area": 0, "border_gap": 0}

    def made(self):
        low, high, gap = (self.config[k] for k in ("min_area", "max_area", "border_gap"))
        return lambda a: kernels.fill_contours(kernels.bridge_border(a, gap), low, high)


class EdgeBlob(FillEdge, name="edge_blob"):
    outputs, defaults = ("blob",), {"min_area": 500, "max_area": 0, "border_gap": 0}


class MorphMask(ArrayKernel, name="morph_mask"):
    inputs, outputs, defaults = ("mask",), ("mask",), {"close_size": 3, "open_size": 3, "reverse": False}

    def made(self):
        from fieldloom.functions.kernels import closing, opening

        c = dict(self.config)

        def run(a):
            if c["reverse"]:
                return closing(opening(a, c["open_size"]), c["close_size"])
            return opening(closing(a, c["close_size"]), c["open_size"])

        return run


def mapped(units: DataFrame, outputs: dict[str, str], kernel: Callable[[dict], dict | None]) -> DataFrame:
    """Units with the columns ``outputs`` (name -> type) set by a kernel from a row as a dict; units for which it
    gives None are skipped. For steps with several or odd outputs; the others use ``regions.map_arrays``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    kept = [f for f in units.schema.fields if f.name not in outputs]
    schema = StructType(kept + StructType.fromDDL(", ".join(f"`{n}` {kind}" for n, kind in outputs.items())).fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, made = [], []
            for i, row in enumerate(batch.to_pylist()):
                out = kernel(row)
                if out:
                    rows.append(i)
                    made.append(out)
            columns = [batch.column(f.name).take(pa.array(rows, pa.int32())) for f in kept]
            columns += [pa.array([m[n] for m in made], arrow.field(n).type) for n in outputs]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return units.mapInArrow(run, schema)


def grid(values, h: int, w: int) -> np.ndarray:
    return np.array(values).reshape(h, w)


def picture(values, h: int, w: int) -> np.ndarray:
    """A frame as (h, w), or (h, w, 3) if it has three values a pixel."""
    a = np.array(values)
    return a.reshape(h, w) if a.size == h * w else a.reshape(h, w, -1)


BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
OBJECTS = f"array<struct<class_id:string,bbox:{BOX}>>"


def _boxes(objects: list[dict]) -> list[tuple | None]:
    return [None if o["bbox"] is None else tuple(o["bbox"][k] for k in ("x0", "y0", "x1", "y1")) for o in objects]


class NormalizeMask(Operator, name="normalize_mask"):
    """PX-NORMMASK: the mask gets a size of its own, so ``h`` and ``w`` change with it."""

    inputs, outputs, defaults = ("mask",), ("mask",), {"target_shape": 224}

    def plan(self, units):
        source, target, size = self.source("mask"), self.target("mask"), self.config["target_shape"]

        def kernel(row):
            cut = kernels.square_crop(grid(row[source], row["h"], row["w"]))
            if cut is None:
                return None
            out = kernels.padded(cut, size)
            return {target: out.ravel().tolist(), "h": out.shape[0], "w": out.shape[1]}

        return mapped(units, {target: "array<int>", "h": "int", "w": "int"}, kernel)


class FrameCrop(Operator, name="frame_crop"):
    """PX-CROP of grey frames: the frame within the mask's box, with its size in ``h`` and ``w``."""

    inputs, outputs = ("frame", "mask"), ("crop",)

    def plan(self, units):
        frame, mask, target = self.source("frame"), self.source("mask"), self.target("crop")

        def kernel(row):
            ys, xs = np.nonzero(grid(row[mask], row["h"], row["w"]))
            if not len(ys):
                return None
            out = grid(row[frame], row["h"], row["w"])[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
            return {target: out.ravel().tolist(), "h": out.shape[0], "w": out.shape[1]}

        return mapped(units, {target: "array<int>", "h": "int", "w": "int"}, kernel)


def _bgr(frame: str, i):
    return tuple(F.get(F.col(frame), (i * 3 + k).cast("int")) for k in range(3))


def _chroma(frame: str, space: str, i):
    if space == "hsv":
        return E.bgr_to_hsv(*_bgr(frame, i))[:2]
    if space == "lab":
        return E.bgr_to_lab_ab(*_bgr(frame, i))
    raise ValueError(f"unknown space: {space}")


#: Bins and circularity of the two channels of a space (fixed values).
SPACES = {"hsv": ((180, True), (256, False)), "lab": ((256, False), (256, False))}


def _pixels():
    return F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)


class ConvertToChroma(Operator, name="convert_to_chroma"):
    """PX-CHROMA of BGR frames (``h * w * 3`` values)."""

    inputs, outputs, defaults = ("frame",), ("chroma_image",), {"space": "hsv"}

    def plan(self, units):
        frame, space = self.source("frame"), self.config["space"]
        SPACES[space]
        return units.withColumn(self.target("chroma_image"), F.transform(_pixels(), lambda i: F.struct(*[c.alias(f"c{k}") for k, c in enumerate(_chroma(frame, space, i))])))


class NormalizeColor(Operator, name="normalize_color"):
    """PX-NORM of BGR frames."""

    inputs, outputs, defaults = ("frame",), ("norm_image",), {"value": 255}

    def plan(self, units):
        frame, value = self.source("frame"), self.config["value"]
        return units.withColumn(self.target("norm_image"), F.flatten(F.transform(_pixels(), lambda i: F.array(*E.normalize_color(*_bgr(frame, i), value)))))


class ChromaDistance(Operator, name="chroma_distance"):
    """PX-DIST from a model in params, global numbers or arrays over the pixels; units without one are skipped."""

    inputs, outputs, defaults = ("frame", "mean_c0", "mean_c1", "std_c0", "std_c1"), ("dist",), {"space": "hsv", "sigma_floor": 1.0}

    def plan(self, units):
        names = [self.source(n) for n in self.inputs[1:]]
        if any(n not in units.columns for n in names):
            return units.where("false").withColumn(self.target("dist"), F.array().cast("array<double>"))
        frame, space, floor = self.source("frame"), self.config["space"], F.lit(float(self.config["sigma_floor"]))

        per_pixel = {n: isinstance(units.schema[n].dataType, ArrayType) for n in names}
        value = lambda n, i: F.get(F.col(n), i) if per_pixel[n] else F.col(n)

        def far(i):
            total = F.lit(0.0)
            for k, c in enumerate(_chroma(frame, space, i)):
                bins, circular = SPACES[space][k]
                d = E.channel_delta(c, value(names[k], i), circular, bins) / F.greatest(value(names[2 + k], i), floor)
                total = total + d * d
            return F.sqrt(total)

        return units.where(" AND ".join(f"{n} IS NOT NULL" for n in names)).withColumn(self.target("dist"), F.transform(_pixels(), far))


class SplitObjects(Operator, name="split_objects"):
    """LBL-SPLIT: label map and the list ``object`` of the unit, which replaces its objects."""

    inputs, outputs = ("mask", "class_id", "roi"), ("segment", "object")
    defaults = {"min_area": 200, "mask_reverse": False, "merge_gap": 0, "bbox_gap": 0.0}

    def plan(self, units):
        mask, klass, roi = (self.source(n) for n in self.inputs)
        segment, listed, c = self.target("segment"), self.target("object"), dict(self.config)

        def kernel(row):
            h, w = row["h"], row["w"]
            area = grid(row[roi], h, w) if row.get(roi) is not None else None
            labels, boxes = kernels.split(grid(row[mask], h, w), c["min_area"], c["merge_gap"], c["bbox_gap"], area, c["mask_reverse"])
            if not boxes:
                return None
            name = str(row.get(klass) or "") or G.UNCLASSIFIED
            return {segment: labels.ravel().tolist(), listed: [{"class_id": name, "bbox": dict(zip(("x0", "y0", "x1", "y1"), b))} for b in boxes]}

        return mapped(units, {segment: "array<int>", listed: OBJECTS}, kernel)


class OrderObjects(Operator, name="order_objects"):
    """ORD-OBJ of a unit's label map and objects."""

    inputs, outputs = ("segment", "object"), ("segment", "object")

    def plan(self, units):
        a, b, segment, listed = self.source("segment"), self.source("object"), self.target("segment"), self.target("object")

        def kernel(row):
            labels, ranks = kernels.order(grid(row[a], row["h"], row["w"]), _boxes(row[b]))
            return {segment: labels.ravel().tolist(), listed: [row[b][i] for i in ranks]}

        return mapped(units, {segment: "array<int>", listed: OBJECTS}, kernel)


class Segment(Operator, name="segment"):
    """MDL-SEG of a unit's objects by the worker's backend; ``text`` is a prompt for backends that take one."""

    inputs, outputs = ("frame", "object"), ("segment", "object")
    defaults = {"conf": 0.5, "min_area": 200, "model": None, "text": ""}

    def holes(self):
        return None

    def plan(self, units):
        from fieldloom.operators import model as M

        frame, objects, segment, listed = self.source("frame"), self.source("object"), self.target("segment"), self.target("object")
        c, holes, (name, build) = self.config, self.holes(), M.configured(self.config["model"])
        conf, least, text = c["conf"], c["min_area"], c["text"]
        debug = {p: self.target(p) for p in self.outputs[2:]} if holes and holes.hole_debug else {}

        def kernel(row):
            given = [(o["class_id"], b) for o, b in zip(row[objects] or [], _boxes(row[objects] or []))]
            labels, kept, maps = M.segmented(M.backend(name, build), picture(row[frame], row["h"], row["w"]), given, conf, least, holes, text)
            if not kept:
                return None
            out = {segment: labels.ravel().tolist(), listed: [{"class_id": k, "bbox": dict(zip(("x0", "y0", "x1", "y1"), b))} for k, b in kept]}
            return out | {target: maps[p].ravel().astype(int).tolist() for p, target in debug.items()}

        return mapped(units, {segment: "array<int>", listed: OBJECTS} | {t: "array<int>" for t in debug.values()}, kernel)


class SegmentWithHole(Segment, name="segment_with_hole"):
    """MDL-HOLE: as ``segment``, with holes carved; with ``hole_debug`` the maps in between are outputs too."""

    outputs = ("segment", "object", "seg_raw", "hole_seed", "hole_grown", "hole_edge")
    defaults = Segment.defaults | asdict(HoleConfig())

    def holes(self):
        return HoleConfig(**{k: v for k, v in self.config.items() if k not in Segment.defaults})


class CombineMask(Operator, name="combine_mask"):
    inputs, outputs, defaults = ("mask", "other"), ("mask",), {"mode": "subtract", "max_change": 0.0, "drop_on_over": False}

    def plan(self, units):
        other = self.source("other")
        if other not in units.columns:
            return units
        mode = self.config["mode"]
        if mode not in ("subtract", "intersect", "union"):
            raise ValueError(f"unknown mode: {mode}")
        f = {"subtract": lambda a, b: F.when(b > 0, 0).otherwise(a), "intersect": lambda a, b: F.when(b > 0, a).otherwise(0), "union": lambda a, b: F.greatest(a, b)}[mode]
        mask = F.col(self.source("mask"))
        new = F.when(F.col(other).isNull(), mask).otherwise(F.zip_with(mask, F.col(other), f))
        limit, drop = self.config["max_change"], self.config["drop_on_over"]
        out = self.target("mask")
        if limit:
            count = lambda a: F.size(F.filter(a, lambda v: v > 0))
            ratio = (count(F.col("_new")) - count(mask)) / count(mask)
            over = ratio > limit if limit > 0 else ratio < limit
            units = units.withColumn("_new", new)
            units = units.where(~over) if drop else units
            units = units.withColumn(out, F.col("_new") if drop else F.when(over, mask).otherwise(F.col("_new"))).drop("_new")
        else:
            units = units.withColumn(out, new)
        return units.where(F.exists(out, lambda v: v > 0))


class RemoveEdgeHoles(Operator, name="remove_edge_holes"):
    inputs, outputs, defaults = ("mask", "edge"), ("mask",), {"boundary_margin": 3, "close_size": 5, "min_area": 80}

    def plan(self, units):
        from fieldloom.functions.kernels import remove_holes

        c = dict(self.config)
        moved = units.withColumn("data", F.col(self.source("mask")).cast("array<int>"))
        return named(G.map_arrays(moved, ["data", self.source("edge")], lambda m, e: remove_holes(m, e, **c)), self.target("mask"))


class Accumulator(Operator, name="accumulator"):
    """FLW-CARRY: a step whose state is an aggregation over all units, planned by ``accumulate``."""

    def plan(self, units):
        return units

    def accumulate(self, units: DataFrame) -> dict[str, DataFrame]:
        raise NotImplementedError


class AccumulateHistogram(Accumulator, name="accumulate_histogram"):
    """One channel of integers."""

    inputs, outputs, defaults = ("image",), ("acc",), {"bins": 256}

    def accumulate(self, units):
        own = units.select(F.explode(F.col(self.source("image"))).alias("v")).select(F.least(F.greatest("v", F.lit(0)), F.lit(self.config["bins"] - 1)).alias("bin"))
        return {"acc": own.groupBy("bin").agg(F.count("*").alias("w"))}


class AccumulateChromaHistogram(Accumulator, name="accumulate_chroma_histogram"):
    """AGG-HIST of a chroma image, over the frame or per pixel ``i``, within the ROI if there is one."""

    inputs, outputs, defaults = ("chroma_image", "roi"), ("c0_acc", "c1_acc"), {"space": "hsv", "per_pixel": False}

    def accumulate(self, units):
        px = units.select(*[c for c in (self.source("roi"),) if c in units.columns], F.posexplode(F.col(self.source("chroma_image"))).alias("i", "c"))
        if self.source("roi") in units.columns:
            roi = F.col(self.source("roi"))
            px = px.where(roi.isNull() | (F.get(roi, F.col("i")) > 0))
        by = ["i"] if self.config["per_pixel"] else []
        out = {}
        for k, (bins, _) in enumerate(SPACES[self.config["space"]]):
            own = px.select(*by, F.least(F.greatest(F.col(f"c.c{k}"), F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))
            out[f"c{k}_acc"] = own.groupBy(*by, "bin").agg(F.count("*").alias("w"))
        return out


class RobustChromaStats(Operator, name="robust_chroma_stats"):
    """Finalize step: AGG-ROBUST of both channels; per-pixel accumulators give one row per pixel ``i``."""

    inputs, outputs, defaults = ("c0_acc", "c1_acc"), ("mean_c0", "mean_c1", "std_c0", "std_c1"), {"space": "hsv"}

    def reduce(self, carried):
        out = {}
        for k, (bins, circular) in enumerate(SPACES[self.config["space"]]):
            hist = carried.get(self.source(f"c{k}_acc"))
            if hist is None:
                return {}
            by = ["i"] if "i" in hist.columns else []
            s = R.robust_stats(hist.withColumn("one", F.lit(1)), ["one", *by], bins, circular)
            out[self.target(f"mean_c{k}")] = s.select(*by, F.col("mu").alias("value"))
            out[self.target(f"std_c{k}")] = s.select(*by, F.col("sigma").alias("value"))
        return out


class RobustStats(Operator, name="robust_stats"):
    """Finalize step: robust mean and deviation of a histogram."""

    inputs, outputs, defaults = ("acc",), ("mean_c0", "std_c0"), {"bins": 256, "circular": False}

    def reduce(self, carried: dict[str, DataFrame]) -> dict[str, DataFrame]:
        hist = carried.get(self.source("acc"))
        if hist is None:
            return {}
        s = R.robust_stats(hist.withColumn("one", F.lit(1)), ["one"], self.config["bins"], self.config["circular"])
        return {self.target("mean_c0"): s.select(F.col("mu").alias("value")), self.target("std_c0"): s.select(F.col("sigma").alias("value"))}


@dataclass
class Flow:
    """A flow config. ``shared`` wins over a step's own value unless ``step_wins``; both only where the step knows the field."""

    unit: str = "frame"
    name: str = ""
    shared: dict[str, Any] = field(default_factory=dict)
    processes: list[str | dict[str, Any]] = field(default_factory=list)
    finalize_processes: list[str | dict[str, Any]] = field(default_factory=list)
    carry: list[str] = field(default_factory=list)
    cacheable: bool = False
    step_wins: bool = False

    def __post_init__(self) -> None:
        if self.unit not in ("frame", "object"):
            raise ValueError(f"unknown unit: {self.unit}")
        if self.carry and self.unit == "object":
            raise ValueError("carry needs unit: frame")
        self.steps = [self._built(p) for p in self.processes]
        self.final = [self._built(p) for p in self.finalize_processes]

    def _built(self, spec: str | dict[str, Any]) -> tuple[Operator, dict[str, dict]]:
        spec = {"op": spec} if isinstance(spec, str) else dict(spec)
        kind = OPERATORS[spec.pop("op")]
        outputs, slots, inputs = spec.pop("outputs", {}), spec.pop("slots", {}), spec.pop("inputs", {})
        known = {k: v for k, v in self.shared.items() if k in kind.defaults}
        op = kind(**(known | spec if self.step_wins else spec | known))
        for names, ports, what in ((slots, kind.outputs, "output"), (inputs, kind.inputs, "input")):
            if bad := [n for n in names if n not in ports]:
                raise KeyError(f"{kind.__name__}: no such {what} ports {bad}")
        op.slots, op.aliases = dict(slots), dict(inputs)
        return op, outputs

    def param_names(self) -> list[str]:
        return [k for _, outputs in self.final for k in outputs]


@dataclass
class FlowResult:
    """``tables``: declared outputs ``(stem[, obj_id], value)``; ``params(name, i, value)``, i being the pixel of per-pixel ones; ``skipped``: outputs without a place.

    ``made``: outputs of each step. ``seen``: if watched, the units before the first step and after each, as observations; :meth:`counts` reads them.
    """

    tables: dict[str, DataFrame]
    params: DataFrame | None
    skipped: list[str]
    cached: bool = False
    made: list[list[str]] = field(default_factory=list)
    seen: list[Observation] = field(default_factory=list)
    known: int = 0

    def counts(self) -> list[tuple[int, int]]:
        """Units that came into each step and units that it kept; the rest was skipped. Steps that have run by now only."""
        n = [o.get["n"] for o in self.seen[: self.known + 1]]
        return list(zip(n, n[1:]))


def units_of(flow: Flow, frames: DataFrame, objects: DataFrame | None) -> DataFrame:
    """FLW-UNIT: every object with its frame's columns, or each frame with its first object's.

    An object's columns cover the frame's of the same name. FLW-WORKING: of frames with a ``category`` only the
    modified ones are units.
    """
    if "category" in frames.columns:
        frames = frames.where(F.col("category") == MODIFIED)
    if objects is None:
        return frames.limit(0) if flow.unit == "object" else frames
    own = objects if flow.unit == "object" else objects.withColumn("_r", F.row_number().over(R.Window.partitionBy("stem").orderBy("obj_id"))).where("_r = 1").drop("_r")
    covered = [c for c in frames.columns if c in own.columns and c != "stem"]
    return frames.drop(*covered).join(own, "stem", "inner" if flow.unit == "object" else "left")


def run_flow(flow: Flow, frames: DataFrame, objects: DataFrame | None = None, params: dict[str, Any] | None = None, watch: bool = False) -> FlowResult:
    """Plan a flow over the working items ``frames(stem, h, w, ...)``; nothing runs until a result is read.

    FLW-CACHE: a cacheable flow whose params all exist already is skipped. If ``watch``, the job that makes an output also counts the units
    before and after each step on its way.
    """
    params = params or {}
    names = flow.param_names()
    if flow.cacheable and names and all(n in params for n in names):
        return FlowResult({}, None, [], cached=True)
    units = units_of(flow, frames, objects)
    for k, v in params.items():
        if k not in units.columns and not isinstance(v, DataFrame):
            units = units.withColumn(k, F.lit(v))
    tables_of = [v.withColumnRenamed("value", k) for k, v in params.items() if isinstance(v, DataFrame) and k not in units.columns]
    if tables_of:  # one row of one array over the pixels for each: a frame's size, however many units there are
        for t in tables_of:
            units = units.withColumn("_one", F.lit(1)).join(F.broadcast(t.withColumn("_one", F.lit(1))), "_one", "left").drop("_one")
    tables, skipped, carried, made, seen = {}, [], {}, [], []

    def counted(units: DataFrame) -> DataFrame:
        if watch:
            seen.append(Observation(uuid.uuid4().hex))
            units = units.observe(seen[-1], F.count(F.lit(1)).alias("n"))
        return units

    units = counted(units)
    for op, outputs in flow.steps:
        units = counted(op.plan(units))
        made.append([])
        if isinstance(op, Accumulator):
            carried |= {op.target(k): v for k, v in op.accumulate(units).items() if op.target(k) in flow.carry}
        for key, spec in outputs.items():
            level = spec.get("level", "object")
            if level == "object" and "obj_id" not in units.columns:
                skipped.append(key)
                continue
            place = ["stem", "obj_id"] if level == "object" else ["stem"]
            own = units.where("obj_id IS NOT NULL") if level == "object" else units
            size = ["h", "w"] if {"h", "w"} <= set(own.columns) and own.schema[key].dataType.simpleString() in ("array<int>", "array<double>") else []
            tables[key] = own.select(*place, key, *size)
            made[-1].append(key)
    out = None
    context: dict[str, DataFrame] = dict(carried)
    for op, outputs in flow.final:
        reduced = op.reduce(context)
        if not reduced:
            break
        context |= reduced
        for key in outputs:
            if key in reduced:
                pixel = F.col("i") if "i" in reduced[key].columns else F.lit(None)
                row = reduced[key].select(F.lit(key).alias("name"), pixel.cast("int").alias("i"), F.col("value").cast("double").alias("value"))
                out = row if out is None else out.unionByName(row)
    return FlowResult(tables, out, skipped, made=made, seen=seen)


def shown(frames: DataFrame, objects: DataFrame | None, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame | None]:
    """What the next flow sees: outputs at the level of frames as columns of the items, the list ``object`` as objects,
    outputs at the level of objects as columns of these. A new value takes the place of an old one of its name."""
    for key, table in tables.items():
        if key == "object" and "obj_id" not in table.columns:
            objects = table.select("stem", F.posexplode("object").alias("obj_id", "o")).select("stem", "obj_id", "o.class_id", "o.bbox")
        elif "obj_id" in table.columns:
            objects = objects.drop(key).join(table.select("stem", "obj_id", key), ["stem", "obj_id"], "left")
        else:
            frames = frames.drop(key).join(table.select("stem", key), "stem", "left")
    return frames, objects


def _param(rows: DataFrame, name: str) -> float | DataFrame | None:
    """A param as a number, or as one row with an array over the pixels."""
    own = rows.where(F.col("name") == name)
    first = own.first()
    if first is None:
        return None
    return first.value if first.i is None else own.agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "value"))), lambda p: p["value"]).alias("value"))


def run_flows(flows: list[Flow], frames: DataFrame, objects: DataFrame | None = None, params: dict[str, Any] | None = None, progress: Callable[[str, int, int], None] | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[list[FlowResult], dict[str, Any]]:
    """FLW-RUN: flows in order; what one put out, tables and params, the next one sees.

    Tables of a flow are kept by ``keep`` (in Spark's storage; give a checkpoint to survive lost executors without
    computing again) before the next flow is planned, as both it and the caller read them. Numbers among the params
    are collected, those per pixel stay tables. FLW-PROGRESS: ``progress(name, k, n)`` as the k-th of a flow's n steps has put out what
    it puts out (a flow that is skipped says n of n); by then ``counts`` of its result has the units up to there. Nothing is counted twice: the
    job that makes an output counts as it goes.
    """
    params, results = dict(params or {}), []
    for flow in flows:
        r = run_flow(flow, frames, objects, params, progress is not None)
        results.append(r)
        name, total = flow.name or "flow", len(flow.steps)
        if progress is not None and r.cached:
            progress(name, total, total)
        r.tables = {k: keep(t) for k, t in r.tables.items()}
        if r.params is not None:
            r.params = keep(r.params)
            params |= {n: v for n in flow.param_names() if (v := _param(r.params, n)) is not None}
        for k, keys in enumerate(r.made if progress is not None else [], 1):
            for key in keys:
                r.tables[key].write.format("noop").mode("overwrite").save()
                r.known = k
            progress(name, k, total)
        frames, objects = shown(frames, objects, r.tables)
    return results, params

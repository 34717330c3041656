"""Connectivity, edges and objects over array-form rasters ``(stem, h, w, data)``.

Each item is one row, so kernels run where the row is: no shuffle, and memory follows one batch of items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import kernels

UNCLASSIFIED = "__unclassified__"


def map_arrays(raster: DataFrame, columns: list[str], kernel: Callable[..., np.ndarray | None], out: str = "data") -> DataFrame:
    """Replace ``out`` by the kernel's raster of the named columns; items for which it gives None are skipped."""
    schema = raster.schema
    keep = [f.name for f in schema.fields if f.name != out]
    kind = "array<int>"
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields if f.name != out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, data = [], []
            shape = list(zip(batch.column("h").to_pylist(), batch.column("w").to_pylist()))
            for i, (h, w) in enumerate(shape):
                args = [np.asarray(batch.column(c)[i].values).reshape(h, w) for c in columns]
                made = kernel(*args)
                if made is not None and made.any():
                    rows.append(i)
                    data.append(made.ravel().astype(np.int32))
            kept = [batch.column(c).take(pa.array(rows, pa.int32())) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(data, pa.list_(pa.int32()))], names=[*keep, out])

    return raster.mapInArrow(run, f"{fields}, {out} {kind}")


def morph(mask: DataFrame, close_size: int = 3, open_size: int = 3, reverse: bool = False) -> DataFrame:
    """NB-MORPH where the row is: CLOSE then OPEN, or the reverse; items that end empty are skipped. ``raster.morph`` does the same over pixels, by eight windows."""
    steps = [(kernels.closing, close_size), (kernels.opening, open_size)]

    def kernel(a: np.ndarray) -> np.ndarray:
        for step, size in reversed(steps) if reverse else steps:
            a = step(a, size)
        return a

    return map_arrays(mask, ["data"], kernel)


def components(mask: DataFrame) -> DataFrame:
    """LBL-CC: label maps, components numbered by their first pixel."""
    return map_arrays(mask, ["data"], kernels.label)


def filter_area(mask: DataFrame, low: int = 0, high: int | None = None) -> DataFrame:
    """AGG-AREA."""
    return map_arrays(mask, ["data"], lambda m: kernels.by_area(m, low, high))


def largest_component(mask: DataFrame) -> DataFrame:
    """LBL-LARGEST."""
    return map_arrays(mask, ["data"], kernels.largest)


def threshold(score: DataFrame, k: float = 1.2, k_weak: float | None = None, invert: bool = False, low: int = 0, high: int = 0, roi: tuple[int, int, int, int] | None = None) -> DataFrame:
    """PX-THRESH: strong threshold, area filter, weak growth, then the bounding box of the ROI."""

    def kernel(d: np.ndarray) -> np.ndarray | None:
        d = d.astype(float)
        if invert:
            m = kernels.hysteresis(-d, -(k if k_weak is None else k_weak), None if k_weak is None else -k, low, high or None)
        else:
            m = kernels.hysteresis(d, k, k_weak, low, high or None)
        if roi is not None:
            y, x, h, w = roi
            cut = np.zeros_like(m)
            cut[y : y + h, x : x + w] = m[y : y + h, x : x + w]
            m = cut
        return m

    return map_arrays(score, ["data"], kernel)


def edges(frame: DataFrame, low: float = 50, high: float = 150, blur: int = 3) -> DataFrame:
    """NB-CANNY on grey frames."""
    return map_arrays(frame, ["data"], lambda a: kernels.canny(a, low, high, blur))


def fill_edges(edge: DataFrame, low: float = 0, high: float = 0) -> DataFrame:
    """NB-FILL and NB-BLOB."""
    return map_arrays(edge, ["data"], lambda e: kernels.fill_contours(e, low, high))


def remove_edge_holes(mask_edge: DataFrame, boundary_margin: int = 3, close_size: int = 5, min_area: int = 80) -> DataFrame:
    """NB-HOLES over ``data`` and ``edge``."""
    return map_arrays(mask_edge, ["data", "edge"], lambda m, e: kernels.remove_holes(m, e, boundary_margin, close_size, min_area))


def grow(mask_seed_edge: DataFrame, boundary_margin: int = 3, close_size: int = 5, barrier_thick: int = 3, iters: int = 12) -> DataFrame:
    """NB-GROW over ``data``, ``seed`` and ``edge``."""
    return map_arrays(mask_seed_edge, ["data", "seed", "edge"], lambda m, s, e: kernels.grow(m, s, e, boundary_margin, close_size, barrier_thick, iters))


def split_objects(mask: DataFrame, min_area: int = 200, reverse: bool = False, merge_gap: float = 0, bbox_gap: float = 0.0, class_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """LBL-SPLIT: label maps, and ``objects(stem, obj_id, class_id, bbox)``."""
    segment = map_arrays(mask, ["data"], lambda m: kernels.split(m, min_area, merge_gap, bbox_gap, reverse=reverse)[0])
    klass = F.coalesce(F.nullif(F.col(class_col).cast("string"), F.lit("")), F.lit(UNCLASSIFIED)) if class_col else F.lit(UNCLASSIFIED)
    px = segment.select("stem", klass.alias("class_id"), "h", "w", F.posexplode("data").alias("i", "label")).where("label > 0")
    box = px.groupBy("stem", "class_id", "label").agg(F.min(F.expr("i % w")).alias("x0"), F.min(F.expr("i div w")).alias("y0"), (F.max(F.expr("i % w")) + 1).alias("x1"), (F.max(F.expr("i div w")) + 1).alias("y1"), F.first("h").alias("h"), F.first("w").alias("w"))
    dx, dy = F.expr(f"(x1 - x0) * {float(bbox_gap)}D / 2"), F.expr(f"(y1 - y0) * {float(bbox_gap)}D / 2")
    bbox = F.struct(F.greatest(F.col("x0") - dx, F.lit(0.0)).alias("x0"), F.greatest(F.col("y0") - dy, F.lit(0.0)).alias("y0"), F.least(F.col("x1") + dx, F.col("w").cast("double")).alias("x1"), F.least(F.col("y1") + dy, F.col("h").cast("double")).alias("y1"))
    return segment, box.select("stem", (F.col("label") - 1).alias("obj_id"), "class_id", bbox.alias("bbox"))


def order_objects(labels: DataFrame, objects: DataFrame, h: int, w: int) -> tuple[DataFrame, DataFrame]:
    """ORD-OBJ: objects by distance of their box centre to the image centre, and the label map renumbered.

    ``labels(stem, y, x, label)`` are pixels, ``objects(stem, obj_id, bbox, ...)``. An object's old label is
    the most frequent one in its rounded box (the lowest on ties); of two objects that claim a label the nearer
    has it. Objects without a box come last and own no pixels.
    """
    b = lambda f: F.col(f"bbox.{f}")
    far = F.pow((b("x0") + b("x1")) / 2 - w / 2, F.lit(2.0)) + F.pow((b("y0") + b("y1")) / 2 - h / 2, F.lit(2.0))
    placed = objects.withColumn("_far", far).withColumn("new_id", F.row_number().over(Window.partitionBy("stem").orderBy(F.asc_nulls_last("_far"), "obj_id")) - 1)
    edge = lambda f, top: F.least(F.greatest(F.rint(b(f)), F.lit(0)), F.lit(top))
    hit = labels.where("label > 0").join(placed.where("bbox IS NOT NULL"), "stem").where((F.col("x") >= edge("x0", w)) & (F.col("x") < edge("x1", w)) & (F.col("y") >= edge("y0", h)) & (F.col("y") < edge("y1", h)))
    own = hit.groupBy("stem", "new_id", "label").agg(F.count("*").alias("n")).groupBy("stem", "new_id").agg(F.max_by("label", F.struct(F.col("n"), -F.col("label"))).alias("label"))
    lut = own.groupBy("stem", "label").agg(F.min("new_id").alias("new_id"))
    moved = labels.join(lut, ["stem", "label"], "left").select("stem", "y", "x", F.coalesce(F.col("new_id") + 1, F.lit(0)).alias("label"))
    rest = [c for c in objects.columns if c not in ("stem", "obj_id")]
    return moved, placed.select("stem", F.col("new_id").alias("obj_id"), F.col("obj_id").alias("old_id"), *rest)


def pack_objects(masks: DataFrame, boxes: DataFrame | None = None) -> DataFrame:
    """ORD-PACK: label pixels ``(stem, y, x, label)`` of object masks ``(stem, obj_id, y, x)``.

    ``boxes(stem, obj_id, x0, y0, x1, y1)`` are those that changed: masks are cut to them. Objects without
    pixels drop out, the rest are renumbered from 0, and later objects cover earlier ones.
    """
    if boxes is not None:
        cut = masks.join(boxes, ["stem", "obj_id"], "left").where("x0 IS NULL OR (x >= x0 AND x < x1 AND y >= y0 AND y < y1)")
        masks = cut.select("stem", "obj_id", "y", "x")
    dense = masks.withColumn("label", F.dense_rank().over(Window.partitionBy("stem").orderBy("obj_id")))
    return dense.groupBy("stem", "y", "x").agg(F.max("label").alias("label"))


def merge_objects(objects: DataFrame, members: DataFrame) -> DataFrame:
    """MRG-OBJ: the members ``(stem, obj_id)`` of each item become one object, if there are two or more.

    Union box, first class that isn't empty, and the least integer that no remaining object has as its id.
    """
    chosen = objects.join(members, ["stem", "obj_id"], "left_semi")
    size = chosen.groupBy("stem").agg(F.count("*").alias("n")).where("n >= 2")
    chosen = chosen.join(size, "stem", "left_semi")
    rest = objects.join(chosen.select("stem", "obj_id"), ["stem", "obj_id"], "left_anti")
    one = chosen.groupBy("stem").agg(
        F.min_by("class_id", F.when(F.coalesce(F.col("class_id"), F.lit("")) != "", F.col("obj_id"))).alias("class_id"),
        F.min("bbox.x0").alias("x0"), F.min("bbox.y0").alias("y0"), F.max("bbox.x1").alias("x1"), F.max("bbox.y1").alias("y1"),
    )
    taken = size.join(rest, "stem", "left").groupBy("stem").agg(F.collect_set("obj_id").alias("ids"))
    free = taken.select("stem", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("ids")), "ids")).alias("obj_id"))
    made = one.join(free, "stem").select("stem", "obj_id", "class_id", F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    return rest.select("stem", "obj_id", "class_id", "bbox").unionByName(made)


def pick_object(objects: DataFrame, points: DataFrame) -> DataFrame:
    """PICK-OBJ: for each point ``(stem, px, py)`` the object whose box holds it, the nearest centre first."""
    b = lambda f: F.col(f"bbox.{f}")
    hit = objects.join(points, "stem").where((F.col("px") >= b("x0")) & (F.col("px") <= b("x1")) & (F.col("py") >= b("y0")) & (F.col("py") <= b("y1")))
    far = F.pow((b("x0") + b("x1")) / 2 - F.col("px"), F.lit(2.0)) + F.pow((b("y0") + b("y1")) / 2 - F.col("py"), F.lit(2.0))
    return hit.groupBy("stem", "px", "py").agg(F.min_by("obj_id", F.struct(far, F.col("obj_id"))).alias("obj_id"))


def next_id(objects: DataFrame) -> DataFrame:
    """ID-NEXT: per item the least unused integer."""
    return objects.groupBy("stem").agg(F.collect_set("obj_id").alias("ids")).select("stem", F.array_min(F.array_except(F.sequence(F.lit(0), F.size("ids")), "ids")).alias("next_id"))


def rename_object(objects: DataFrame, old: int, new: int) -> DataFrame:
    """ID-NEXT: rename an id in each item, unless the item has the new one already."""
    item = Window.partitionBy("stem")
    taken = F.max((F.col("obj_id") == new).cast("int")).over(item)
    return objects.withColumn("obj_id", F.when((F.col("obj_id") == old) & (taken == 0), new).otherwise(F.col("obj_id")))


def add_object(objects: DataFrame, stems: DataFrame) -> DataFrame:
    """ID-NEXT: an empty object with the least unused id in each of the items ``stems(stem)``."""
    free = stems.select("stem").distinct().join(next_id(objects), "stem", "left").select("stem", F.coalesce("next_id", F.lit(0)).cast(objects.schema["obj_id"].dataType).alias("obj_id"))
    rest = [F.lit(None).cast(f.dataType).alias(f.name) for f in objects.schema if f.name not in ("stem", "obj_id")]
    return objects.unionByName(free.select("stem", "obj_id", *rest))


def delete_objects(objects: DataFrame, chosen: DataFrame) -> DataFrame:
    """ID-NEXT: without the chosen ``(stem, obj_id)``."""
    return objects.join(chosen.select("stem", "obj_id"), ["stem", "obj_id"], "left_anti").select(objects.columns)


def rle_strings(rle: DataFrame) -> DataFrame:
    """RLE: run-length counts as COCO text, ``(stem, h, w, counts string)``."""
    from fieldloom.functions.codecs import coco_string

    @F.pandas_udf("string")
    def text(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: coco_string([int(v) for v in c]))

    return rle.withColumn("counts", text("counts"))


def rle_from_strings(rle: DataFrame) -> DataFrame:
    """The inverse of :func:`rle_strings`."""
    from fieldloom.functions.codecs import coco_counts

    @F.pandas_udf("array<int>")
    def counts(text: pd.Series) -> pd.Series:
        return text.map(coco_counts)

    return rle.withColumn("counts", counts("counts"))


def fill_holes(mask: DataFrame) -> DataFrame:
    """NB-FILLHOLES."""
    return map_arrays(mask, ["data"], kernels.fill_holes)


def finalize(grown_seed: DataFrame, open_size: int = 5) -> DataFrame:
    """NB-FINAL over ``data`` and ``seed``."""
    return map_arrays(grown_seed, ["data", "seed"], lambda g, s: kernels.finalize(g, s, open_size))


def colour_seed(raster: DataFrame, channels: list[str], light: str | None, **config) -> DataFrame:
    """NB-SEED over the mask ``data`` and array-form channels; ``light`` is None for spaces without a brightness of their own."""
    n = len(channels)
    return map_arrays(raster, [*channels, "data", *([light] if light else [])], lambda *a: kernels.colour_seed(np.stack(a[:n], axis=2), a[n], a[n + 1] if light else None, **config))


def spread_points(mask: DataFrame, k: int) -> DataFrame:
    """NB-POINTS: ``(stem, i, x, y)`` of ``k`` pixels of each mask, evenly spaced in row order; all if it has no more."""
    at = F.filter(F.transform("data", lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull())
    n = F.size("at")
    m = F.least(F.lit(max(k, 1)), n)
    rows = mask.select("stem", "w", at.alias("at")).where(n > 0).select("stem", "w", "at", F.explode(F.sequence(F.lit(0), m - 1)).alias("i"))
    place = F.get("at", F.when(m > 1, F.floor(F.col("i") * (n - 1) / (m - 1))).otherwise(0).cast("int"))
    return rows.select("stem", F.col("i"), (place % F.col("w")).cast("int").alias("x"), F.floor(place / F.col("w")).cast("int").alias("y"))

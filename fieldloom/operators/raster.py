"""Rasters in two forms, and the pointwise and aggregating operators over pixels.

Pixel form: ``(stem, y, x, value columns)``, one row per pixel. Array form: ``(stem, h, w, data array)``, one
row per item in row order. Pointwise and aggregating operators take pixels and stay in Catalyst; connectivity
and the like take arrays (see ``regions``). At rest rasters are arrays; pixels live within a stage.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import kernels as K


def to_pixels(raster: DataFrame, value: str = "v", keep: tuple[str, ...] = ()) -> DataFrame:
    """Array form to pixel form."""
    px = raster.select("stem", "w", *keep, F.posexplode("data").alias("i", value))
    return px.select("stem", *keep, F.expr("i div w").cast("int").alias("y"), F.expr("i % w").cast("int").alias("x"), value)


def to_raster(px: DataFrame, h: int, w: int, value: str = "v") -> DataFrame:
    """Pixel form to array form; missing pixels are 0."""
    cells = F.map_from_entries(F.collect_list(F.struct((F.col("y") * w + F.col("x")).alias("i"), F.col(value).cast("int").alias("v"))))
    return px.groupBy("stem").agg(cells.alias("m")).select("stem", F.lit(h).alias("h"), F.lit(w).alias("w"), F.transform(F.sequence(F.lit(0), F.lit(h * w - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0))).alias("data"))


def roi_box(px: DataFrame, y: int, x: int, h: int, w: int) -> DataFrame:
    """PX-ROI by bounding box ``(y, x, h, w)``."""
    return px.where(F.col("y").between(y, y + h - 1) & F.col("x").between(x, x + w - 1))


def roi_mask(px: DataFrame, mask: DataFrame) -> DataFrame:
    """PX-ROI by exact pixels ``(y, x)``; the mask is one frame, so it is small."""
    return px.join(F.broadcast(mask.select("y", "x").distinct()), ["y", "x"], "left_semi")


def histogram(px: DataFrame, channels: dict[str, int], by: list[str]) -> DataFrame:
    """AGG-HIST: ``(by, channel, bin, w)``, values cut to ``[0, bins - 1]`` and truncated. Sparse, so its size
    follows the bins in use, not the frame."""
    bins = F.array(*[F.struct(F.lit(c).alias("channel"), F.least(F.greatest(F.col(c), F.lit(0)), F.lit(n - 1)).cast("int").alias("bin")) for c, n in channels.items()])
    return px.select(*by, F.explode(bins).alias("b")).select(*by, "b.channel", "b.bin").groupBy(*by, "channel", "bin").agg(F.count("*").alias("w"))


def robust_stats(hist: DataFrame, by: list[str], bins: int, circular: bool) -> DataFrame:
    """AGG-ROBUST: ``(by, mu, sigma)`` from a sparse histogram ``(by, bin, w)``.

    Quantiles are the first bin whose cumulated weight reaches ``p * total``; circular channels are recentred
    about the lowest most frequent bin first. Sigma is the interquartile range over 1.349.
    """
    group = Window.partitionBy(*by)
    mode = F.max_by("bin", F.struct(F.col("w"), -F.col("bin"))).over(group)
    at = F.pmod(F.col("bin") - F.col("mode") + bins // 2, F.lit(bins)) - bins // 2 if circular else F.col("bin")
    placed = hist.withColumn("mode", mode).withColumn("at", at)
    run = placed.withColumn("cum", F.sum("w").over(group.orderBy("at"))).withColumn("total", F.sum("w").over(group))
    q = lambda p: F.min(F.when(F.col("cum") >= F.col("total") * p, F.col("at")))
    out = run.groupBy(*by).agg(F.first("mode").alias("mode"), q(0.5).alias("q50"), q(0.25).alias("q25"), q(0.75).alias("q75"))
    mu = F.pmod(F.col("mode") + F.col("q50"), F.lit(bins)) if circular else F.col("q50")
    return out.select(*by, mu.cast("double").alias("mu"), ((F.col("q75") - F.col("q25")) / 1.349).alias("sigma"))


def distance(px: DataFrame, model: DataFrame, on: list[str], circular: tuple[bool, bool], periods: tuple[int, int], floor: float = 1.0) -> DataFrame:
    """PX-DIST: ``d`` of two channels from a model ``(on, mean_c0, std_c0, mean_c1, std_c1)``; unmatched pixels are skipped.

    With ``on`` empty the model is one row; per-pixel models are one frame. Both are small and broadcast.
    """
    from fieldloom.functions.expressions import channel_delta

    own = px.withColumn("_one", F.lit(1))
    joined = own.join(F.broadcast(model.withColumn("_one", F.lit(1))), ["_one", *on]).drop("_one")
    parts = [F.pow(channel_delta(F.col(f"c{i}"), F.col(f"mean_c{i}"), circular[i], periods[i]) / F.greatest(F.col(f"std_c{i}"), F.lit(floor)), F.lit(2.0)) for i in (0, 1)]
    return joined.withColumn("d", F.sqrt(parts[0] + parts[1])).drop("mean_c0", "std_c0", "mean_c1", "std_c1")


def distance_frames(frames: DataFrame, model: DataFrame, circular: tuple[bool, bool], periods: tuple[int, int], floor: float = 1.0) -> DataFrame:
    """PX-DIST in array form: ``(stem, h, w, d array)`` of frames ``(stem, h, w, c0 array, c1 array)`` of one size from a per-pixel model ``(y, x, mean_c0, ...)``.

    The model becomes one row of arrays, of a frame's size however many frames there are, so that no pixel is exploded or joined.
    Pixels without a model are null.
    """
    from fieldloom.functions.expressions import channel_delta

    names = ("mean_c0", "std_c0", "mean_c1", "std_c1")
    width = frames.select("w", F.lit(1).alias("_one")).limit(1)
    placed = model.withColumn("_one", F.lit(1)).join(F.broadcast(width), "_one").select((F.col("y") * F.col("w") + F.col("x")).cast("int").alias("i"), *names)
    row = placed.agg(F.map_from_entries(F.collect_list(F.struct("i", F.struct(*names)))).alias("m"), F.max("i").alias("last"))
    row = row.select(F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.col("m")[i]).alias("model"), F.lit(1).alias("_one"))

    def far(i):
        own, total = F.get("model", i), F.lit(0.0)
        for k in (0, 1):
            d = channel_delta(F.get(f"c{k}", i), own[f"mean_c{k}"], circular[k], periods[k]) / F.greatest(own[f"std_c{k}"], F.lit(floor))
            total = total + d * d
        return F.when(own.isNotNull(), F.sqrt(total))

    return frames.withColumn("_one", F.lit(1)).join(F.broadcast(row), "_one").select("stem", "h", "w", F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), far).alias("d"))


def combine(mask: DataFrame, other: DataFrame, mode: str, max_change: float = 0.0, drop_on_over: bool = False) -> DataFrame:
    """PX-COMBINE over foreground pixels ``(stem, y, x)``: subtract, intersect or union.

    ``max_change`` limits ``(new - old) / old`` of an item: a positive limit trips above it, a negative one
    below; a tripped item keeps its old pixels, or is skipped if ``drop_on_over``.
    """
    key = ["stem", "y", "x"]
    a, b = mask.select(key), other.select(key)
    if mode == "subtract":
        new = a.join(b, key, "left_anti")
    elif mode == "intersect":
        new = a.join(b, key, "left_semi")
    elif mode == "union":
        new = a.union(b.join(a.select("stem").distinct(), "stem", "left_semi")).distinct()
    else:
        raise ValueError(f"unknown mode: {mode}")
    if not max_change:
        return new
    # one pass over tagged pixels gives the counts of both, and the tripped items
    tagged = new.withColumn("_new", F.lit(1)).unionByName(a.withColumn("_new", F.lit(0)))
    item = Window.partitionBy("stem")
    n, o = F.sum("_new").over(item), F.sum(1 - F.col("_new")).over(item)
    ratio = (n - o) / o
    tripped = ratio > max_change if max_change > 0 else ratio < max_change
    kept = tagged.withColumn("_over", tripped).where("NOT _over AND _new = 1" if drop_on_over else "(_over AND _new = 0) OR (NOT _over AND _new = 1)")
    return kept.select(key)


def bbox(fg: DataFrame, by: list[str]) -> DataFrame:
    """AGG-BBOX: XYXY of the foreground, max exclusive."""
    return fg.groupBy(*by).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.max("x") + 1).alias("x1"), (F.max("y") + 1).alias("y1"))


def centroid(fg: DataFrame, by: list[str]) -> DataFrame:
    """AGG-CENTROID and AGG-AREAPX."""
    return fg.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count("*").alias("area"))


def crop(px: DataFrame, fg: DataFrame) -> DataFrame:
    """PX-CROP: pixels within the box of the item's mask, shifted to its corner; items without mask are skipped."""
    return px.join(bbox(fg, ["stem"]), "stem").where("x >= x0 AND x < x1 AND y >= y0 AND y < y1").withColumn("x", F.expr("x - x0")).withColumn("y", F.expr("y - y0")).drop("x0", "x1", "y0", "y1")


def square(fg: DataFrame, ratio: float = 1.0) -> DataFrame:
    """PX-SQUARE: foreground in the square about the box's middle, with the square's side; outside is empty."""
    box = fg.groupBy("stem").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    box = box.select("stem", F.expr("(x0 + x1) div 2").alias("cx"), F.expr("(y0 + y1) div 2").alias("cy"), F.floor(F.greatest(F.expr("x1 - x0 + 1"), F.expr("y1 - y0 + 1")) * F.lit(float(ratio))).cast("int").alias("side"))
    out = fg.join(box, "stem").select("stem", F.expr("cast(y - (cy - side div 2) as int)").alias("y"), F.expr("cast(x - (cx - side div 2) as int)").alias("x"), "side")
    return out.where("y >= 0 AND x >= 0 AND y < side AND x < side")


def pad(fg: DataFrame, target: int) -> DataFrame:
    """PX-PAD: centred on a ``target`` square unless the square is as large already."""
    shift = F.when(F.col("side") >= target, 0).otherwise(F.expr(f"({target} - side) div 2"))
    return fg.select("stem", (F.col("y") + shift).cast("int").alias("y"), (F.col("x") + shift).cast("int").alias("x"), F.greatest("side", F.lit(target)).cast("int").alias("side"))


def normalize_mask(fg: DataFrame, target: int = 224) -> DataFrame:
    """PX-NORMMASK."""
    return pad(square(fg), target)


def cut_to_box(fg: DataFrame, boxes: DataFrame, on: list[str], h: int, w: int) -> DataFrame:
    """PX-BOXCUT: foreground within each item's rounded, sorted and clamped box ``(x0, y0, x1, y1)``."""
    edge = lambda a, b, top: (F.least(F.greatest(F.rint(F.least(a, b)), F.lit(0)), F.lit(top)), F.least(F.greatest(F.rint(F.greatest(a, b)), F.lit(0)), F.lit(top)))
    x0, x1 = edge("x0", "x1", w)
    y0, y1 = edge("y0", "y1", h)
    return fg.join(boxes, on).where((F.col("x") >= x0) & (F.col("x") < x1) & (F.col("y") >= y0) & (F.col("y") < y1)).select(fg.columns)


def object_mask(labels: DataFrame, obj_id: int) -> DataFrame:
    """PX-OBJMASK: pixels of one object of a label map."""
    return labels.where(F.col("label") == obj_id + 1)


def binary(score: Column) -> Column:
    """PX-BIN."""
    return F.when(score > 0.5, 255).otherwise(0)


def resized(raster: DataFrame, h: int | None = None, w: int | None = None, method: str = "linear") -> DataFrame:
    """``(stem, ..., h, w, data)`` at the size (h, w), or at each row's own ``to_h`` and ``to_w``: ``linear``, ``area`` or ``nearest``.

    A frame's weights are two small matrices, one for each axis, so it costs two products where its row is. ``channels`` may be a column.
    """
    if h is not None:
        raster = raster.withColumn("to_h", F.lit(h)).withColumn("to_w", F.lit(w))
    keep = [f for f in raster.schema.fields if f.name not in ("h", "w", "to_h", "to_w", "data")]
    several = "channels" in raster.columns

    def run(batches):
        for batch in batches:
            take = lambda c: batch.column(c).to_pylist()
            sizes = list(zip(take("h"), take("w"), take("to_h"), take("to_w"), take("channels") if several else [1] * len(batch)))
            data = [K.resized(np.asarray(batch.column("data")[i].values).reshape(a, b, c), y, x, method).ravel() for i, (a, b, y, x, c) in enumerate(sizes)]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in keep], pa.array([s[2] for s in sizes], pa.int32()), pa.array([s[3] for s in sizes], pa.int32()), pa.array(data, pa.list_(pa.int32()))], names=[*[f.name for f in keep], "h", "w", "data"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return raster.mapInArrow(run, f"{fields}, h int, w int, data array<int>")


def blend_frames(layers: DataFrame) -> DataFrame:
    """PX-BLEND of frames ``(stem, place, h, w, data)`` of one channel: all at the size of the first place's, then their mean, truncated; ``(stem, h, w, data)``.

    Layers without data don't count.
    """
    layers = layers.where("data IS NOT NULL")
    first = layers.groupBy("stem").agg(F.min_by(F.struct("h", "w"), "place").alias("c"))
    same = resized(layers.join(first, "stem").select("stem", "place", "h", "w", F.col("c.h").alias("to_h"), F.col("c.w").alias("to_w"), "data"))
    # sums of whole frames would keep arrays; sums by pixel combine before they are shuffled
    px = same.select("stem", "h", "w", F.posexplode("data").alias("i", "v")).groupBy("stem", "h", "w", "i").agg(F.floor(F.avg("v")).cast("int").alias("v"))
    return px.groupBy("stem", "h", "w").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("data"))


def blend(layers: DataFrame) -> DataFrame:
    """PX-BLEND: mean of layers ``(stem, y, x, v)``, truncated."""
    return layers.groupBy("stem", "y", "x").agg(F.floor(F.avg("v")).cast("int").alias("v"))


def overlay(px: DataFrame, fg: DataFrame, colour: int, alpha: float = 0.45) -> DataFrame:
    """PX-OVERLAY of one channel: masked pixels are mixed with the colour."""
    return px.join(fg.select("stem", "y", "x", F.lit(1).alias("_hit")), ["stem", "y", "x"], "left").withColumn("v", F.when(F.col("_hit") == 1, F.floor((1 - alpha) * F.col("v") + alpha * colour).cast("int")).otherwise(F.col("v"))).drop("_hit")


def composed(frames: DataFrame, layers: DataFrame, alpha: float = 0.45) -> DataFrame:
    """PX-OVERLAY: ``(stem, h, w, channels, data)`` of frames under ``layers (stem, place, colour array, mask array, bbox struct<x0, y0, x1, y1>)`` in order of place.

    Masks are at the size of the frame, null masks and boxes aren't shown. A frame's layers, few as its objects are, come to it as one
    array, and frames without layers stay as they are.
    """
    own = layers.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("place", "colour", "mask", "bbox"))).alias("layers"))
    rows = frames.select("stem", "h", "w", "channels", "data").join(own, "stem", "left")
    box = lambda b: None if b is None else tuple(b[k] for k in ("x0", "y0", "x1", "y1"))

    def run(batches):
        for batch in batches:
            data = []
            for i, (h, w, c, own) in enumerate(zip(*(batch.column(n).to_pylist() for n in ("h", "w", "channels", "layers")))):
                frame = np.asarray(batch.column("data")[i].values).reshape(h, w, c)
                shown = [(x["colour"], None if x["mask"] is None or len(x["mask"]) != h * w else np.array(x["mask"]).reshape(h, w), box(x["bbox"])) for x in own or []]
                data.append(K.composed(frame, shown, alpha).ravel())
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in ("stem", "h", "w", "channels")], pa.array(data, pa.list_(pa.int32()))], names=["stem", "h", "w", "channels", "data"])

    return rows.mapInArrow(run, f"stem {frames.schema['stem'].dataType.simpleString()}, h int, w int, channels int, data array<int>")


def _painted(fg: DataFrame, stems: DataFrame, box: tuple[int, int, int, int], inside: Column, erase: bool) -> DataFrame:
    """Adds to the foreground of ``stems``, or takes from it, the pixels of a box (first row and column, last row and column) for which ``inside`` holds."""
    key, (y0, x0, y1, x1) = ["stem", "y", "x"], box
    if y0 > y1 or x0 > x1:
        return fg.select(key)
    rows = stems.select("stem", F.explode(F.sequence(F.lit(y0), F.lit(y1))).alias("y"))
    brush = rows.select("stem", "y", F.explode(F.sequence(F.lit(x0), F.lit(x1))).alias("x")).where(inside)
    return fg.select(key).join(brush, key, "left_anti") if erase else fg.select(key).union(brush).distinct()


def paint_disc(fg: DataFrame, stems: DataFrame, cy: int, cx: int, radius: int, h: int, w: int, erase: bool = False) -> DataFrame:
    """PX-PAINT: add or erase a disc."""
    dy, dx = F.col("y") - cy, F.col("x") - cx
    return _painted(fg, stems, (max(cy - radius, 0), max(cx - radius, 0), min(cy + radius, h - 1), min(cx + radius, w - 1)), dy * dy + dx * dx <= radius * radius, erase)


def paint_polygon(fg: DataFrame, stems: DataFrame, points: list[tuple[float, float]], h: int, w: int, erase: bool = False) -> DataFrame:
    """PX-PAINT: add or erase a polygon of (x, y) corners by the even-odd rule at pixel centres; fewer than three do nothing."""
    if len(points) < 3:
        return fg.select("stem", "y", "x")
    y, x, crossings = F.col("y"), F.col("x"), F.lit(0)
    for (xa, ya), (xb, yb) in zip(points, points[1:] + points[:1]):
        if ya != yb:
            hit = ((F.lit(ya) > y) != (F.lit(yb) > y)) & (x < (xb - xa) * (y - ya) / float(yb - ya) + xa)
            crossings = crossings + hit.cast("int")
    xs, ys = zip(*points)
    box = (max(math.floor(min(ys)), 0), max(math.floor(min(xs)), 0), min(math.ceil(max(ys)), h - 1), min(math.ceil(max(xs)), w - 1))
    return _painted(fg, stems, box, crossings % 2 == 1, erase)


def _sweep(px: DataFrame, value: str, size: int, agg) -> DataFrame:
    """One separable pass over rows, then columns. An even kernel reaches one further back (anchor size // 2)."""
    back, ahead = size // 2, size - 1 - size // 2
    rows = Window.partitionBy("stem", "y").orderBy("x").rangeBetween(-back, ahead)
    cols = Window.partitionBy("stem", "x").orderBy("y").rangeBetween(-back, ahead)
    return px.withColumn(value, agg(value).over(rows)).withColumn(value, agg(value).over(cols))


def dilate(px: DataFrame, value: str, size: int) -> DataFrame:
    """NB-KERNEL, NB-MORPH: maximum over a rectangle of a dense raster; outside pixels don't count."""
    return _sweep(px, value, size, F.max) if size > 1 else px


def erode(px: DataFrame, value: str, size: int) -> DataFrame:
    return _sweep(px, value, size, F.min) if size > 1 else px


def closing(px: DataFrame, value: str, size: int) -> DataFrame:
    """NB-CLOSE."""
    return erode(dilate(px, value, size), value, size)


def opening(px: DataFrame, value: str, size: int) -> DataFrame:
    return dilate(erode(px, value, size), value, size)


def morph(px: DataFrame, value: str, close_size: int = 3, open_size: int = 3, reverse: bool = False) -> DataFrame:
    """NB-MORPH: CLOSE then OPEN, or the reverse; items that end empty are skipped."""
    steps = [(closing, close_size), (opening, open_size)]
    for step, size in reversed(steps) if reverse else steps:
        px = step(px, value, size)
    return px.withColumn("_any", F.max(value).over(Window.partitionBy("stem"))).where("_any > 0").drop("_any")


def bridge_border(px: DataFrame, value: str, gap: int, h: int, w: int, margin: int = 2) -> DataFrame:
    """NB-BORDER: in a band of ``margin`` pixels on each side, close gaps up to ``gap`` of the presence along the
    side, and paint the new places over the whole band."""
    if gap <= 0:
        return px
    size = gap + 1
    back, ahead = size // 2, size - 1 - size // 2
    out = px.withColumn("_on", (F.col(value) > 0).cast("int"))
    new = F.lit(False)
    for name, band, along in (("t", f"y < {margin}", "x"), ("b", f"y >= {h - margin}", "x"), ("l", f"x < {margin}", "y"), ("r", f"x >= {w - margin}", "y")):
        own = Window.partitionBy("stem", along)
        seen = F.max(F.when(F.expr(band), F.col("_on")).otherwise(0)).over(own)
        out = out.withColumn(f"_{name}", seen)
        across = "y" if along == "x" else "x"
        line = Window.partitionBy("stem", across).orderBy(along).rangeBetween(-back, ahead)
        out = out.withColumn(f"_{name}d", F.max(f"_{name}").over(line)).withColumn(f"_{name}c", F.min(f"_{name}d").over(line))
        new = new | (F.expr(band) & (F.col(f"_{name}c") > F.col(f"_{name}")))
    return out.withColumn(value, F.when(new, F.lit(255)).otherwise(F.col(value))).select(px.columns)


def rle_runs(px: DataFrame, value: str, h: int, w: int) -> DataFrame:
    """RLE: ``(stem, h, w, counts)`` column-major run lengths, the first run being of zeros (0 if there is none)."""
    item = Window.partitionBy("stem").orderBy("i")
    bits = px.select("stem", (F.col("x") * h + F.col("y")).alias("i"), (F.col(value) > 0).cast("int").alias("v"))
    starts = bits.withColumn("p", F.lag("v", 1, 0).over(item)).where("v <> p")
    ends = starts.select("stem", F.col("i").cast("int").alias("i"))
    runs = px.select("stem").distinct().join(ends.groupBy("stem").agg(F.array_sort(F.collect_list("i")).alias("cuts")), "stem", "left")
    cuts = F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array(F.lit(h * w)))
    counts = F.transform(F.sequence(F.lit(2), F.size("all")), lambda k: F.element_at("all", k) - F.element_at("all", k - 1))
    return runs.withColumn("all", cuts).select("stem", F.lit(h).alias("h"), F.lit(w).alias("w"), counts.alias("counts"))


def rle_pixels(rle: DataFrame) -> DataFrame:
    """RLE decode: foreground ``(stem, y, x)``."""
    runs = rle.select("stem", "h", F.posexplode("counts").alias("k", "n"), F.col("counts").alias("all"))
    begin = F.aggregate(F.slice("all", F.lit(1), F.col("k")), F.lit(0), lambda a, b: a + b)
    own = runs.withColumn("b", begin).where("k % 2 = 1 AND n > 0").select("stem", "h", F.explode(F.sequence(F.col("b"), F.col("b") + F.col("n") - 1)).alias("i"))
    return own.select("stem", F.expr("i % h").cast("int").alias("y"), F.expr("i div h").cast("int").alias("x"))

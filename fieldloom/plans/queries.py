"""Registered queries over the reference operators, each with its SQL oracle where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions import expressions as E
from fieldloom.functions.expressions import rounded
from fieldloom.operators import catalog as C
from fieldloom.operators import diagnostics as D
from fieldloom.operators import raster as R
from fieldloom.operators import regions as G

from . import fixtures as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- sources and names -------------------------------------------------------------------------------------------


def _names(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    frames = X.table(s, d, "documents").select(F.concat(F.col("doc_id").cast("string"), F.lit("_pose.png")).alias("name"))
    labels = X.table(s, d, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("_pose.txt")).alias("name"), F.col("quality").alias("class_id"))
    return frames, labels


@query("""SELECT CAST(d.doc_id AS VARCHAR) AS stem, d.doc_id || '_pose.png' AS frame, l.quality AS class_id FROM documents d JOIN labels l USING (doc_id)""")
def stem_inner_join(s, d):
    frames, labels = _names(s, d)
    a = frames.select(E.extract_stem(F.col("name"), "*_pose.png").alias("stem"), F.col("name").alias("frame"))
    return a.join(labels.select(E.extract_stem(F.col("name"), "*_pose.txt").alias("stem"), "class_id"), "stem")


@query("""SELECT doc_id || '_pose.png' AS name, CAST(doc_id AS VARCHAR) AS stem, doc_id || '_pose' AS bare, CAST(NULL AS VARCHAR) AS misfit FROM documents""")
def stem_extract(s, d):
    n = F.col("name")
    return _names(s, d)[0].select("name", E.extract_stem(n, "*_pose.png").alias("stem"), E.extract_stem(n, "frame.png").alias("bare"), E.extract_stem(n, "*_pose.txt").alias("misfit"))


@query("""SELECT CAST(doc_id AS VARCHAR) || e AS name, CASE WHEN lower(e) IN ('.png', '.jpg') THEN 'image' WHEN e = '.npy' THEN 'array' WHEN e = '.txt' THEN 'attr' END AS type
FROM documents, (SELECT unnest(['.png', '.JPG', '.npy', '.txt', '.bin']) AS e) AS x""")
def ext_type_inference(s, d):
    ends = F.explode(F.array(*[F.lit(x) for x in (".png", ".JPG", ".npy", ".txt", ".bin")]))
    names = X.table(s, d, "documents").select("doc_id", ends.alias("e")).select(F.concat(F.col("doc_id").cast("string"), "e").alias("name"))
    return names.select("name", E.infer_type(E.file_extension(F.col("name"))).alias("type"))


# --- catalogue ---------------------------------------------------------------------------------------------------

_REFS, _HOST, _OTHER = X.catalog_sql(), X.catalog_sql("host"), X.catalog_sql("other")


@query(f"WITH {_REFS} SELECT category || '/' || stem AS path, name, 'attr' AS type FROM refs")
def catalog_iter_leaves(s, d):
    return C.leaves(X.catalog(s, d)).select(F.array_join("path", "/").alias("path"), "name", "type")


def _sixes(s, d):
    return X.table(s, d, "documents").where("doc_id % 6 = 1").select(F.col("doc_id").cast("string").alias("stem"))


@query(f"WITH {_REFS} SELECT CASE WHEN CAST(stem AS BIGINT) % 6 = 1 THEN 'staged' ELSE category END AS category, stem, name FROM refs")
def catalog_move(s, d):
    return C.move(X.catalog(s, d), _sixes(s, d), "staged").select("category", "stem", "name")


@query(f"WITH {_REFS} SELECT category, stem, name FROM refs WHERE CAST(stem AS BIGINT) % 6 <> 1")
def catalog_delete(s, d):
    return C.delete(X.catalog(s, d), _sixes(s, d)).select("category", "stem", "name")


@query(f"""WITH {_HOST}, {_OTHER}, home AS (SELECT DISTINCT stem, category AS home FROM host)
SELECT category, stem, name, value FROM host UNION ALL
SELECT o.category, o.stem, o.name, o.value FROM other o LEFT JOIN home USING (stem) LEFT JOIN host h ON h.stem = o.stem AND h.name = o.name
WHERE (home IS NULL OR home = o.category) AND h.name IS NULL""")
def catalog_merge_skip(s, d):
    return C.merge(X.catalog(s, d, "host"), X.catalog(s, d, "other")).select("category", "stem", "name", "value")


@query(f"WITH {_HOST}, {_OTHER} SELECT category, stem, name, value FROM host WHERE stem NOT IN (SELECT stem FROM other) UNION ALL SELECT category, stem, name, value FROM other")
def catalog_merge_override(s, d):
    return C.merge(X.catalog(s, d, "host"), X.catalog(s, d, "other"), override=True).select("category", "stem", "name", "value")


@query(f"WITH {_HOST}, {_OTHER} SELECT DISTINCT stem FROM other WHERE stem IN (SELECT stem FROM host)")
def catalog_merge_conflicts(s, d):
    return C.conflicts(X.catalog(s, d, "host"), X.catalog(s, d, "other"))


@query(f"WITH {_REFS} SELECT category, stem, CAST(row_number() OVER (PARTITION BY category ORDER BY stem) - 1 AS INT) AS seq FROM (SELECT DISTINCT category, stem FROM refs)")
def catalog_state_numbering(s, d):
    return C.stats(X.catalog(s, d))


@query(f"WITH {_REFS} SELECT CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT stem, category FROM refs WHERE CAST(stem AS BIGINT) % 6 = 1) WHERE category <> 'staged'")
def catalog_not_in_state(s, d):
    return C.not_in_state(X.catalog(s, d), _sixes(s, d), "staged")


@query("SELECT CAST(doc_id AS VARCHAR) AS stem, lang AS value FROM documents")
def catalog_attr(s, d):
    return C.attr(X.catalog(s, d), "lang")


@query(f"WITH {_REFS} SELECT category, stem, string_agg(name || '=' || value, ',' ORDER BY name) AS leaves FROM refs GROUP BY 1, 2")
def gather_bundle(s, d):
    return C.gather(X.catalog(s, d)).select("category", "stem", F.array_join(F.transform("leaves", lambda x: F.concat_ws("=", x["name"], x["value"])), ",").alias("leaves"))


@query("""SELECT doc_id, CASE WHEN b < 8000 THEN 'train' WHEN b < 9000 THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 10000 AS b FROM documents)""")
def sample_split_hash(s, d):
    from .sampling import split

    return split(X.table(s, d, "documents"), "doc_id").select("doc_id", "split")


# --- histograms and background models --------------------------------------------------------------------------------

_CH = {"c0": 180, "c1": 256}


def _hist_sql(by: str, where: str = "true") -> str:
    g = f"{by}, " if by else ""
    return f"""hist AS (SELECT {g}channel, bin, count(*) AS w FROM (
  SELECT {g}'c0' AS channel, c0 AS bin FROM px WHERE {where} UNION ALL SELECT {g}'c1', c1 FROM px WHERE {where}) GROUP BY ALL)"""


@query(f"WITH {X.PX}, {_hist_sql('')} SELECT channel, bin, CAST(w AS BIGINT) AS w FROM hist")
def chroma_hist_global(s, d):
    return R.histogram(X.pixels(s, d), _CH, [])


@query(f"WITH {X.PX}, {_hist_sql('y, x')} SELECT y, x, channel, bin, CAST(w AS BIGINT) AS w FROM hist")
def chroma_hist_per_pixel(s, d):
    return R.histogram(X.pixels(s, d), _CH, ["y", "x"])


@query(f"WITH {X.PX}, {_hist_sql('', '(x - 3.5) * (x - 3.5) + (y - 3.5) * (y - 3.5) <= 9')} SELECT channel, bin, CAST(w AS BIGINT) AS w FROM hist")
def chroma_hist_roi(s, d):
    px = X.pixels(s, d)
    disc = s.createDataFrame([(y, x) for y in range(8) for x in range(8) if (x - 3.5) ** 2 + (y - 3.5) ** 2 <= 9], "y int, x int")
    return R.histogram(R.roi_mask(px, disc), _CH, [])


@query(f"WITH {X.PX}, {_hist_sql('', 'y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5')} SELECT channel, bin, CAST(w AS BIGINT) AS w FROM hist")
def chroma_hist_roi_box(s, d):
    return R.histogram(R.roi_box(X.pixels(s, d), 2, 2, 4, 4), _CH, [])


def _robust(bins: int, circular: bool, value: str) -> str:
    return f"""WITH {X.PX}, hist AS (SELECT label, {value} AS bin, count(*) AS w FROM px GROUP BY ALL), {X.robust_sql('hist', 'label', bins, circular)}
SELECT label, mu, round(sigma, 6) AS sigma FROM stats"""


def _label_hist(s, d, value):
    return X.pixels(s, d).groupBy("label", F.col(value).alias("bin")).agg(F.count("*").alias("w"))


@query(_robust(256, False, "v"))
def robust_stats_linear(s, d):
    return R.robust_stats(_label_hist(s, d, "v"), ["label"], 256, False).select("label", "mu", rounded(F.col("sigma")).alias("sigma"))


@query(_robust(180, True, "c0"))
def robust_stats_circular(s, d):
    return R.robust_stats(_label_hist(s, d, "c0"), ["label"], 180, True).select("label", "mu", rounded(F.col("sigma")).alias("sigma"))


def _model_sql(by: str) -> str:
    """CTE model(by, mean_c0, std_c0, mean_c1, std_c1) by plain moments, so that distance is tested by itself."""
    g = f"{by}, " if by else ""
    return f"model AS (SELECT {g}round(avg(c0), 3) AS mean_c0, round(stddev_pop(c0), 3) AS std_c0, round(avg(c1), 3) AS mean_c1, round(stddev_pop(c1), 3) AS std_c1 FROM px {'GROUP BY ' + by if by else ''})"


def _model(px, by):
    m = lambda f, c: F.round(f(c), 3)
    return px.groupBy(*by).agg(m(F.avg, "c0").alias("mean_c0"), m(F.stddev_pop, "c0").alias("std_c0"), m(F.avg, "c1").alias("mean_c1"), m(F.stddev_pop, "c1").alias("std_c1"))


_DIST = "sqrt(pow(least(abs(c0 - mean_c0), 180 - abs(c0 - mean_c0)) / greatest(std_c0, 1), 2) + pow((c1 - mean_c1) / greatest(std_c1, 1), 2))"


@query(f"""WITH {X.PX}, own AS (SELECT 1 AS k, stem, y, x, c0, c1 FROM px), model AS (SELECT k, round(avg(c0), 3) AS mean_c0, round(stddev_pop(c0), 3) AS std_c0, round(avg(c1), 3) AS mean_c1, round(stddev_pop(c1), 3) AS std_c1 FROM own GROUP BY k)
SELECT stem, y, x, round({_DIST}, 6) AS d FROM own JOIN model ON own.k = model.k""")
def chroma_distance_global(s, d):
    px = X.pixels(s, d).withColumn("k", F.lit(1))
    return R.distance(px, _model(px, ["k"]), ["k"], (True, False), (180, 256)).select("stem", "y", "x", rounded(F.col("d")).alias("d"))


@query(f"WITH {X.PX}, {_model_sql('y, x')} SELECT stem, y, x, round({_DIST}, 6) AS d FROM px JOIN model USING (y, x)")
def chroma_distance_per_pixel(s, d):
    hue = F.transform("data", lambda v: F.floor(v * 180 / 256).cast("int"))
    frames = X.raster(s, d).select("stem", "h", "w", hue.alias("c0"), F.reverse("data").alias("c1"))
    far = R.distance_frames(frames, _model(X.pixels(s, d), ["y", "x"]), (True, False), (180, 256))
    return R.to_pixels(far.withColumnRenamed("d", "data"), "d").select("stem", "y", "x", rounded(F.col("d")).alias("d"))


@query("""SELECT stem, y, x, h, s, greatest(b, g, r) AS v FROM (SELECT *, CAST(floor(CASE WHEN hh < 0 THEN hh + 360 ELSE hh END / 2 + 0.5) AS INT) % 180 AS h, CAST(floor(CASE WHEN mx = 0 THEN 0 ELSE 255.0 * dd / mx END + 0.5) AS INT) AS s FROM (
SELECT *, CASE WHEN dd = 0 THEN 0.0 WHEN mx = r THEN 60.0 * (g - b) / dd WHEN mx = g THEN 120 + 60.0 * (b - r) / dd ELSE 240 + 60.0 * (r - g) / dd END AS hh FROM (
SELECT stem, y, x, b, g, r, greatest(b, g, r) AS mx, CAST(greatest(b, g, r) - least(b, g, r) AS DOUBLE) AS dd FROM (WITH """ + X.PX + """ SELECT stem, y, x, v AS b, c1 AS g, c0 AS r FROM px))))""")
def chroma_convert_hsv(s, d):
    h, sat, v = E.bgr_to_hsv(F.col("v"), F.col("c1"), F.col("c0"))
    return X.pixels(s, d).select("stem", "y", "x", h.alias("h"), sat.alias("s"), v.alias("v"))


_HSV = ORACLES["chroma_convert_hsv"]


@query(f"""WITH hsv AS ({_HSV}), six AS (SELECT stem, y, x, s AS c, 255 - s AS m, s * (1 - abs((h * 2 / 60.0) % 2 - 1)) AS z, CAST(floor(h * 2 / 60.0) AS INT) % 6 + 1 AS k FROM hsv)
SELECT stem, y, x, CAST(floor([0, 0, z, c, c, z][k] + m + 0.5) AS INT) AS b, CAST(floor([z, c, c, z, 0, 0][k] + m + 0.5) AS INT) AS g, CAST(floor([c, z, 0, 0, z, c][k] + m + 0.5) AS INT) AS r FROM six""")
def normalize_color(s, d):
    b, g, r = E.normalize_color(F.col("v"), F.col("c1"), F.col("c0"))
    return X.pixels(s, d).select("stem", "y", "x", b.alias("b"), g.alias("g"), r.alias("r"))


# --- masks ---------------------------------------------------------------------------------------------------------------


@query(f"WITH {X.PX} SELECT stem, y, x FROM px WHERE v > 160")
def threshold_plain(s, d):
    return _fg(G.threshold(X.raster(s, d), 160))


@query(f"WITH {X.PX} SELECT stem, y, x FROM px WHERE -v > -90 AND y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5")
def threshold_invert(s, d):
    return _fg(G.threshold(X.raster(s, d), 90, invert=True, roi=(2, 2, 4, 4)))


@query(f"""WITH RECURSIVE {X.PX}, m AS (SELECT stem, y, x FROM px WHERE v > 150), {X.COMPONENTS},
seeds AS (SELECT DISTINCT stem, cc.label FROM cc JOIN px USING (stem, y, x) WHERE v > 190)
SELECT stem, y, x FROM cc JOIN seeds USING (stem, label)""")
def threshold_hysteresis(s, d):
    return _fg(G.threshold(X.raster(s, d), 190, 150))


def _fg(array_form: DataFrame) -> DataFrame:
    return R.to_pixels(array_form).where("v > 0").select("stem", "y", "x")


@query(f"WITH {X.PX}, {X.FG}, {X.OTHER} SELECT * FROM fg EXCEPT SELECT * FROM other")
def combine_subtract(s, d):
    return R.combine(X.foreground(s, d), X.other_mask(s, d), "subtract")


@query(f"WITH {X.PX}, {X.FG}, {X.OTHER} SELECT * FROM fg INTERSECT SELECT * FROM other")
def combine_intersect(s, d):
    return R.combine(X.foreground(s, d), X.other_mask(s, d), "intersect")


@query(f"WITH {X.PX}, {X.FG}, {X.OTHER} SELECT * FROM (SELECT * FROM fg UNION SELECT * FROM other) WHERE stem IN (SELECT stem FROM fg)")
def combine_union(s, d):
    return R.combine(X.foreground(s, d), X.other_mask(s, d), "union")


@query(f"""WITH {X.PX}, {X.FG}, {X.OTHER}, new AS (SELECT * FROM fg EXCEPT SELECT * FROM other),
n AS (SELECT stem, count(*) AS old_n FROM fg GROUP BY 1), k AS (SELECT stem, count(*) AS new_n FROM new GROUP BY 1),
over AS (SELECT stem FROM n LEFT JOIN k USING (stem) WHERE (coalesce(new_n, 0) - old_n) / old_n < -0.3)
SELECT * FROM new WHERE stem NOT IN (SELECT stem FROM over) UNION ALL SELECT * FROM fg WHERE stem IN (SELECT stem FROM over)""")
def combine_max_change(s, d):
    return R.combine(X.foreground(s, d), X.other_mask(s, d), "subtract", max_change=-0.3)


@query(f"WITH {X.PX}, {X.FG} SELECT stem, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM fg GROUP BY 1")
def mask_bbox(s, d):
    return R.bbox(X.foreground(s, d), ["stem"])


@query(f"WITH {X.PX}, {X.FG} SELECT stem, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, count(*) AS area FROM fg GROUP BY 1")
def mask_centroid(s, d):
    return R.centroid(X.foreground(s, d), ["stem"]).select("stem", rounded(F.col("cx")).alias("cx"), rounded(F.col("cy")).alias("cy"), "area")


_BOX = "box AS (SELECT stem, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fg GROUP BY 1)"


@query(f"WITH {X.PX}, {X.FG}, {_BOX} SELECT stem, y - y0 AS y, x - x0 AS x, v FROM px JOIN box USING (stem) WHERE x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1")
def frame_crop(s, d):
    return R.crop(X.pixels(s, d).select("stem", "y", "x", "v"), X.foreground(s, d)).select("stem", "y", "x", "v")


_SQUARE = f"""{X.PX}, {X.FG}, {_BOX}, sq AS (SELECT stem, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy, CAST(floor(greatest(x1 - x0 + 1, y1 - y0 + 1) * 1.5) AS INT) AS side FROM box),
cut AS (SELECT stem, y - (cy - side // 2) AS y, x - (cx - side // 2) AS x, side FROM fg JOIN sq USING (stem))"""


@query(f"WITH {_SQUARE} SELECT * FROM cut WHERE y >= 0 AND x >= 0 AND y < side AND x < side")
def crop_square(s, d):
    return R.square(X.foreground(s, d), 1.5)


@query(f"WITH {_SQUARE} SELECT stem, CAST(y + CASE WHEN side >= 20 THEN 0 ELSE (20 - side) // 2 END AS INT) AS y, CAST(x + CASE WHEN side >= 20 THEN 0 ELSE (20 - side) // 2 END AS INT) AS x, greatest(side, 20) AS side FROM cut WHERE y >= 0 AND x >= 0 AND y < side AND x < side")
def mask_pad(s, d):
    return R.pad(R.square(X.foreground(s, d), 1.5), 20)


@query(f"WITH {X.PX}, {X.FG} SELECT stem, y, x FROM fg WHERE x >= 1 AND x < 6 AND y >= 2 AND y < 8")
def mask_box_cut(s, d):
    fg = X.foreground(s, d)
    boxes = fg.select("stem").distinct().select("stem", F.lit(5.6).alias("x0"), F.lit(1.5).alias("y0"), F.lit(1.2).alias("x1"), F.lit(11.0).alias("y1"))
    return R.cut_to_box(fg, boxes, ["stem"], 8, 8)


@query(f"WITH {X.PX} SELECT stem, y, x, CAST(floor((v + c1) / 2) AS INT) AS v FROM px")
def layer_blend(s, d):
    px = X.pixels(s, d)
    return R.blend(px.select("stem", "y", "x", "v").union(px.select("stem", "y", "x", "c1")))


@query(f"WITH {X.PX} SELECT stem, y, x, CASE WHEN v > 160 THEN CAST(floor(CAST(0.55 AS DOUBLE) * v + CAST(0.45 AS DOUBLE) * 200) AS INT) ELSE v END AS v FROM px")
def layer_overlay(s, d):
    return R.overlay(X.pixels(s, d).select("stem", "y", "x", "v"), X.foreground(s, d), 200).select("stem", "y", "x", "v")


@query(f"WITH {X.PX}, {X.FG}, {X.OTHER} SELECT stem, y, x FROM fg UNION SELECT stem, y, x FROM px WHERE (y - 3) * (y - 3) + (x - 4) * (x - 4) <= 4")
def paint_disc(s, d):
    return R.paint_disc(X.foreground(s, d), X.raster(s, d).select("stem"), 3, 4, 2, 8, 8)


# --- morphology and run lengths --------------------------------------------------------------------------------------


def _dense(s, d):
    return X.pixels(s, d).select("stem", "y", "x", F.when(F.col("v") > 160, 255).otherwise(0).alias("v"))


_DENSE = f"{X.PX}, b AS (SELECT stem, y, x, CASE WHEN v > 160 THEN 255 ELSE 0 END AS v FROM px)"


def _morph_sql(steps: list[tuple[int, str]], nonempty: bool = True) -> str:
    ctes, src = [], "b"
    for i, (size, op) in enumerate(steps):
        ctes.append(X.sweep_sql(src, f"s{i}", size, op))
        src = f"s{i}"
    keep = f" WHERE stem IN (SELECT stem FROM {src} WHERE v > 0)" if nonempty else ""
    return f"WITH {_DENSE}, {', '.join(ctes)} SELECT stem, y, x, v FROM {src}{keep}"


@query(_morph_sql([(3, "max"), (3, "min"), (3, "min"), (3, "max")]))
def morph_close_open(s, d):
    return R.to_pixels(G.morph(X.mask(s, d))).select("stem", "y", "x", "v")


@query(_morph_sql([(2, "min"), (2, "max"), (3, "max"), (3, "min")]))
def morph_open_close(s, d):
    return R.to_pixels(G.morph(X.mask(s, d), 3, 2, reverse=True)).select("stem", "y", "x", "v")


@query(_morph_sql([(3, "max"), (3, "min"), (2, "min"), (2, "max")]))
def morph_of_pixels(s, d):
    """The same in Catalyst alone, over pixels."""
    return R.morph(_dense(s, d), "v", 3, 2)


@query(_morph_sql([(5, "max"), (5, "min")], nonempty=False))
def edge_close(s, d):
    return R.closing(_dense(s, d), "v", 5)


def _bridge_sql(gap: int) -> str:
    size = gap + 1
    back, ahead = size // 2, size - 1 - size // 2
    parts, joins, new = [], [], []
    for n, band, along in (("t", "y < 2", "x"), ("b", "y >= 6", "x"), ("l", "x < 2", "y"), ("r", "x >= 6", "y")):
        frame = f"OVER (PARTITION BY stem ORDER BY {along} RANGE BETWEEN {back} PRECEDING AND {ahead} FOLLOWING)"
        parts.append(f"{n}1 AS (SELECT stem, {along}, max(CASE WHEN {band} AND v > 0 THEN 1 ELSE 0 END) AS p FROM b GROUP BY 1, 2), {n}2 AS (SELECT *, max(p) {frame} AS dd FROM {n}1), {n}3 AS (SELECT stem, {along}, p, min(dd) {frame} AS cc FROM {n}2)")
        joins.append(f"JOIN {n}3 ON {n}3.stem = b.stem AND {n}3.{along} = b.{along}")
        new.append(f"({band.replace('y', 'b.y').replace('x', 'b.x')} AND {n}3.cc > {n}3.p)")
    return f"WITH {_DENSE}, {', '.join(parts)} SELECT b.stem, b.y, b.x, CASE WHEN {' OR '.join(new)} THEN 255 ELSE b.v END AS v FROM b {' '.join(joins)}"


@query(_bridge_sql(2))
def border_bridge(s, d):
    return R.bridge_border(_dense(s, d), "v", 2, 8, 8)


_RLE = f"""{_DENSE}, o AS (SELECT stem, x * 8 + y AS i, CASE WHEN v > 0 THEN 1 ELSE 0 END AS v FROM b),
cuts AS (SELECT stem, i FROM (SELECT *, coalesce(lag(v) OVER (PARTITION BY stem ORDER BY i), 0) AS p FROM o) WHERE v <> p),
pts AS (SELECT DISTINCT stem, 0 AS k, 0 AS i FROM o UNION ALL SELECT stem, 1, i FROM cuts UNION ALL SELECT DISTINCT stem, 2, 64 FROM o),
runs AS (SELECT stem, i, k, lead(i) OVER (PARTITION BY stem ORDER BY k, i) - i AS n FROM pts)"""


@query(f"WITH {_RLE} SELECT stem, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k, i) AS counts FROM runs WHERE n IS NOT NULL GROUP BY 1")
def rle_encode(s, d):
    return R.rle_runs(_dense(s, d), "v", 8, 8).select("stem", F.array_join(F.col("counts").cast("array<string>"), ",").alias("counts"))


@query(f"WITH {X.PX}, {X.FG} SELECT stem, y, x FROM fg")
def rle_decode(s, d):
    return R.rle_pixels(R.rle_runs(_dense(s, d), "v", 8, 8))


# --- connectivity and objects -----------------------------------------------------------------------------------------

_CC = f"{X.PX}, m AS (SELECT stem, y, x FROM px WHERE v > 160), {X.COMPONENTS}"


@query(f"WITH RECURSIVE {_CC} SELECT stem, y, x, label FROM cc")
def component_label(s, d):
    return R.to_pixels(G.components(X.mask(s, d)), "label").where("label > 0").select("stem", "y", "x", "label")


@query(f"WITH RECURSIVE {_CC}, a AS (SELECT stem, label FROM cc GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 5) SELECT stem, y, x FROM cc JOIN a USING (stem, label)")
def area_filter(s, d):
    return _fg(G.filter_area(X.mask(s, d), 2, 5))


@query(f"""WITH RECURSIVE {_CC}, a AS (SELECT stem, label, row_number() OVER (PARTITION BY stem ORDER BY count(*) DESC, label) AS rn FROM cc GROUP BY 1, 2)
SELECT stem, y, x FROM cc JOIN a USING (stem, label) WHERE rn = 1""")
def largest_component(s, d):
    return _fg(G.largest_component(X.mask(s, d)))


_OBJ = f"""{_CC}, raw AS (SELECT stem, label, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1, count(*) AS n FROM cc GROUP BY 1, 2 HAVING count(*) >= 2),
obj AS (SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY label) - 1 AS INT) AS obj_id, label,
  greatest(x0 - (x1 - x0) * 0.25 / 2, 0) AS x0, greatest(y0 - (y1 - y0) * 0.25 / 2, 0) AS y0, least(x1 + (x1 - x0) * 0.25 / 2, 8) AS x1, least(y1 + (y1 - y0) * 0.25 / 2, 8) AS y1 FROM raw)"""


def _objects(s, d):
    return G.split_objects(X.mask(s, d), min_area=2, bbox_gap=0.25, class_col="label")


@query(f"WITH RECURSIVE {_OBJ} SELECT o.stem, obj_id, CAST(e.label AS VARCHAR) AS class_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM obj o JOIN embeddings e ON e.vec_id = o.stem")
def split_objects(s, d):
    return _objects(s, d)[1].select("stem", F.col("obj_id").cast("int").alias("obj_id"), "class_id", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


_ORDER = """ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY stem ORDER BY pow((x0 + x1) / 2 - 4, 2) + pow((y0 + y1) / 2 - 4, 2), obj_id) - 1 AS INT) AS new_id FROM obj)"""


@query(f"WITH RECURSIVE {_OBJ}, {_ORDER} SELECT stem, new_id AS obj_id, obj_id AS old_id FROM ranked")
def order_objects(s, d):
    seg, obj = _objects(s, d)
    return G.order_objects(R.to_pixels(seg, "label"), obj, 8, 8)[1].select("stem", F.col("obj_id").cast("int").alias("obj_id"), F.col("old_id").cast("int").alias("old_id"))


@query(f"""WITH RECURSIVE {_OBJ}, {_ORDER}, lab AS (SELECT cc.stem, y, x, obj_id + 1 AS label FROM cc JOIN obj USING (stem, label)),
hit AS (SELECT r.stem, r.new_id, l.label, count(*) AS n FROM ranked r JOIN lab l ON l.stem = r.stem AND x >= round_even(r.x0, 0) AND x < round_even(r.x1, 0) AND y >= round_even(r.y0, 0) AND y < round_even(r.y1, 0) GROUP BY 1, 2, 3),
own AS (SELECT stem, new_id, label FROM (SELECT *, row_number() OVER (PARTITION BY stem, new_id ORDER BY n DESC, label) AS rn FROM hit) WHERE rn = 1),
lut AS (SELECT stem, label, min(new_id) AS new_id FROM own GROUP BY 1, 2)
SELECT stem, y, x, CAST(new_id + 1 AS INT) AS label FROM lab JOIN lut USING (stem, label)""")
def order_objects_segment(s, d):
    seg, obj = _objects(s, d)
    return G.order_objects(R.to_pixels(seg, "label"), obj, 8, 8)[0].where("label > 0").select("stem", "y", "x", F.col("label").cast("int").alias("label"))


_MASKS = "masks AS (SELECT cc.stem, obj_id, y, x FROM cc JOIN obj USING (stem, label) WHERE obj_id <> 1 UNION ALL SELECT stem, 9, y, x FROM px WHERE v > 200)"


@query(f"""WITH RECURSIVE {_OBJ}, {_MASKS}, r AS (SELECT *, dense_rank() OVER (PARTITION BY stem ORDER BY obj_id) AS label FROM masks)
SELECT stem, y, x, CAST(max(label) AS INT) AS label FROM r GROUP BY 1, 2, 3""")
def pack_objects(s, d):
    seg, _ = _objects(s, d)
    own = R.to_pixels(seg, "label").where("label > 0").select("stem", (F.col("label") - 1).alias("obj_id"), "y", "x").where("obj_id <> 1")
    extra = X.foreground(s, d, 200).select("stem", F.lit(9).alias("obj_id"), "y", "x")
    return G.pack_objects(own.union(extra)).select("stem", "y", "x", F.col("label").cast("int").alias("label"))


@query(f"""WITH RECURSIVE {_OBJ}, mem AS (SELECT * FROM obj WHERE obj_id < 2), big AS (SELECT stem FROM mem GROUP BY 1 HAVING count(*) >= 2),
rest AS (SELECT * FROM obj WHERE NOT (obj_id < 2 AND stem IN (SELECT stem FROM big)))
SELECT stem, obj_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM rest UNION ALL
SELECT stem, 0, CAST(min(x0) AS DOUBLE), CAST(min(y0) AS DOUBLE), CAST(max(x1) AS DOUBLE), CAST(max(y1) AS DOUBLE) FROM mem WHERE stem IN (SELECT stem FROM big) GROUP BY stem""")
def merge_objects(s, d):
    _, obj = _objects(s, d)
    return G.merge_objects(obj, obj.where("obj_id < 2").select("stem", "obj_id")).select("stem", F.col("obj_id").cast("int").alias("obj_id"), "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


@query(f"""WITH RECURSIVE {_OBJ} SELECT stem, obj_id FROM (SELECT stem, obj_id, row_number() OVER (PARTITION BY stem ORDER BY pow((x0 + x1) / 2 - 3, 2) + pow((y0 + y1) / 2 - 2, 2), obj_id) AS rn
FROM obj WHERE 3 BETWEEN x0 AND x1 AND 2 BETWEEN y0 AND y1) WHERE rn = 1""")
def pick_object(s, d):
    _, obj = _objects(s, d)
    points = X.raster(s, d).select("stem", F.lit(3).alias("px"), F.lit(2).alias("py"))
    return G.pick_object(obj, points).select("stem", F.col("obj_id").cast("int").alias("obj_id"))


@query(f"WITH RECURSIVE {_OBJ} SELECT stem, CAST(max(obj_id) + 1 AS INT) AS next_id FROM obj GROUP BY 1")
def next_object_id(s, d):
    return G.next_id(_objects(s, d)[1]).select("stem", F.col("next_id").cast("int").alias("next_id"))


def _with_edge(s, d):
    edge = F.transform(F.col("data"), lambda v: F.when((v > 60) & (v <= 110), 255).otherwise(0))
    r = X.raster(s, d).withColumn("edge", edge).withColumn("seed", F.transform("data", lambda v: F.when(v > 200, 255).otherwise(0)))
    return r.withColumn("data", F.transform("data", lambda v: F.when(v > 60, 255).otherwise(0)))


_EDGE = f"{X.PX}, b AS (SELECT stem, y, x, CASE WHEN v > 60 THEN 1 ELSE 0 END AS v FROM px), e0 AS (SELECT stem, y, x, CASE WHEN v > 60 AND v <= 110 THEN 1 ELSE 0 END AS v FROM px)"
_BARRIER = f"""{_EDGE}, {X.sweep_sql('b', 'inner_', 3, 'min')}, be AS (SELECT stem, y, x, least(e0.v, inner_.v) AS v FROM e0 JOIN inner_ USING (stem, y, x)),
{X.sweep_sql('be', 'bd', 2, 'max')}, {X.sweep_sql('bd', 'bc', 2, 'min')}"""


@query(f"""WITH RECURSIVE {_BARRIER}, m AS (SELECT b.stem, b.y, b.x FROM b JOIN bc USING (stem, y, x) WHERE b.v = 1 AND bc.v = 0), {X.COMPONENTS},
band AS (SELECT DISTINCT cc.stem, label FROM cc JOIN inner_ USING (stem, y, x) WHERE inner_.v = 0),
drop_ AS (SELECT stem, label FROM cc GROUP BY 1, 2 HAVING count(*) >= 2 EXCEPT SELECT * FROM band)
SELECT b.stem, b.y, b.x FROM b LEFT JOIN cc USING (stem, y, x) LEFT JOIN drop_ ON drop_.stem = b.stem AND drop_.label = cc.label WHERE b.v = 1 AND drop_.label IS NULL""")
def remove_enclosed(s, d):
    return _fg(G.remove_edge_holes(_with_edge(s, d), boundary_margin=3, close_size=2, min_area=2))


def _grow_sql(iters: int) -> str:
    ctes, src = [f"allowed AS (SELECT b.stem, b.y, b.x, CASE WHEN b.v = 1 AND bt.v = 0 THEN 1 ELSE 0 END AS v FROM b JOIN bt USING (stem, y, x))", "g0 AS (SELECT px.stem, px.y, px.x, CASE WHEN px.v > 200 AND a.v = 1 THEN 1 ELSE 0 END AS v FROM px JOIN allowed a USING (stem, y, x))"], "g0"
    for i in range(1, iters + 1):
        ctes += [X.sweep_sql(src, f"d{i}", 3, "max"), f"g{i} AS (SELECT stem, y, x, least(d{i}.v, a.v) AS v FROM d{i} JOIN allowed a USING (stem, y, x))"]
        src = f"g{i}"
    return f"WITH {_BARRIER}, {X.sweep_sql('bc', 'bt', 2, 'max')}, {', '.join(ctes)} SELECT stem, y, x FROM {src} WHERE v = 1"


@query(_grow_sql(3))
def geodesic_grow(s, d):
    return _fg(G.grow(_with_edge(s, d), boundary_margin=3, close_size=2, barrier_thick=2, iters=3))


# --- diagnostics ---------------------------------------------------------------------------------------------------------


def _px_hist(s, d):
    return X.pixels(s, d).groupBy("y", "x", F.col("c1").alias("bin")).agg(F.count("*").alias("w"))


_PXS = f"{X.PX}, hist AS (SELECT y, x, c1 AS bin, count(*) AS w FROM px GROUP BY ALL), {X.robust_sql('hist', 'y, x', 256, False)}, pxs AS (SELECT y, x, mu, sigma, n FROM stats JOIN (SELECT y, x, sum(w) AS n FROM hist GROUP BY 1, 2) USING (y, x))"


@query(f"WITH {_PXS} SELECT y, x, mu, round(sigma, 6) AS sigma, CAST(n AS BIGINT) AS n FROM pxs")
def pixel_stats(s, d):
    return D.pixel_stats(_px_hist(s, d), 256, False).select("y", "x", "mu", rounded(F.col("sigma")).alias("sigma"), "n")


@query(f"WITH px_stats AS (WITH {_PXS} SELECT * FROM pxs), vh AS (SELECT 1 AS one, CAST(round_even(mu, 0) AS INT) AS bin, count(*) AS w FROM px_stats GROUP BY 2), {X.robust_sql('vh', 'one', 256, False)} SELECT mu, round(sigma, 6) AS sigma FROM stats")
def global_vote_robust(s, d):
    px = D.pixel_stats(_px_hist(s, d), 256, False).withColumn("one", F.lit(1))
    return R.robust_stats(D.votes(px, "mu", ["one"], 256), ["one"], 256, False).select("mu", rounded(F.col("sigma")).alias("sigma"))


@query(f"""WITH {_PXS}, a AS (SELECT count(*) AS valid_px, sum(n * sigma * sigma) / sum(n) AS within, sum(n * mu) / sum(n) AS m, sum(n * mu * mu) / sum(n) AS m2, quantile_cont(sigma, 0.5) AS med FROM pxs)
SELECT valid_px, round(sqrt(within), 6) AS within_std, round(sqrt(m2 - m * m), 6) AS between_std, round((m2 - m * m) / (within + m2 - m * m), 6) AS spatial_fraction, round(m, 6) AS weighted_mean, round(med, 6) AS median_pixel_std FROM a""")
def variance_partition(s, d):
    out = D.variance_partition(D.pixel_stats(_px_hist(s, d), 256, False), False, 256, 10)
    return out.select("valid_px", *[rounded(F.col(c)).alias(c) for c in out.columns[1:]])


@query(f"""WITH {X.PX}, a AS (SELECT label, sum(v + 1) AS w, sum((v + 1) * cos(c0 * 2 * pi() / 180)) AS c, sum((v + 1) * sin(c0 * 2 * pi() / 180)) AS s FROM px GROUP BY 1),
r AS (SELECT label, atan2(s / w, c / w) AS t, least(greatest(sqrt(c / w * c / w + s / w * s / w), 1e-12), 1) AS r FROM a)
SELECT label, round((CASE WHEN t < 0 THEN t + 2 * pi() ELSE t END) * 180 / (2 * pi()), 6) AS circ_mean, round(sqrt(-2 * ln(r)) * 180 / (2 * pi()), 6) AS circ_std FROM r""")
def circular_resultant(s, d):
    out = D.circular_resultant(X.pixels(s, d).withColumn("wt", F.col("v") + 1), "c0", "wt", ["label"], 180.0)
    return out.select("label", rounded(F.col("circ_mean")).alias("circ_mean"), rounded(F.col("circ_std")).alias("circ_std"))


def _diagnosis_sql() -> str:
    parts = []
    for c, bins, cir in (("c0", 180, True), ("c1", 256, False)):
        far = f"least(abs(g - vm), {bins} - abs(g - vm))" if cir else "abs(g - vm)"
        parts.append(f"""SELECT '{c}' AS channel, g AS g_mean, round(gs, 6) AS g_std, vm AS vote_mean, {far} > 0.05 * {bins} AS contaminated FROM
 (WITH {X.PX}, hist AS (SELECT 1 AS one, {c} AS bin, count(*) AS w FROM px GROUP BY ALL), {X.robust_sql('hist', 'one', bins, cir)} SELECT mu AS g, sigma AS gs FROM stats) AS a,
 (WITH p AS (WITH {X.PX}, hist AS (SELECT y, x, {c} AS bin, count(*) AS w FROM px GROUP BY ALL), {X.robust_sql('hist', 'y, x', bins, cir)} SELECT mu FROM stats),
  vh AS (SELECT 1 AS one, CAST(least(greatest(round_even(mu, 0), 0), {bins - 1}) AS INT) AS bin, count(*) AS w FROM p GROUP BY 2), {X.robust_sql('vh', 'one', bins, cir)} SELECT mu AS vm FROM stats) AS b""")
    return " UNION ALL ".join(parts)


@query(_diagnosis_sql())
def chroma_diagnosis(s, d):
    hist = R.histogram(X.pixels(s, d), _CH, ["y", "x"])
    return D.chroma_diagnosis(hist, {"c0": (180, True), "c1": (256, False)}).select("channel", "g_mean", rounded(F.col("g_std")).alias("g_std"), "vote_mean", "contaminated")


@query()
def chroma_recommend(s, d):
    return D.recommend(D.chroma_diagnosis(R.histogram(X.pixels(s, d), _CH, ["y", "x"]), {"c0": (180, True), "c1": (256, False)}))


@query("""WITH m AS (SELECT CASE WHEN vec_id % 11 = 0 THEN -1 WHEN vec_id % 4 <> 0 THEN label ELSE (label + 3) % 10 END AS cluster, label AS cls FROM embeddings),
n AS (SELECT cluster, cls, count(*) AS n FROM m GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, cls) AS rn FROM n)
SELECT cluster, CAST(sum(n) AS BIGINT) AS size, min(CASE WHEN rn = 1 THEN cls END) AS dominant, round(max(n) / sum(n), 6) AS purity FROM r GROUP BY 1""")
def cluster_purity(s, d):
    e = X.table(s, d, "embeddings")
    cluster = F.when(F.col("vec_id") % 11 == 0, -1).when(F.col("vec_id") % 4 != 0, F.col("label")).otherwise((F.col("label") + 3) % 10)
    return D.purity(e.select(cluster.alias("cluster"), F.col("label").alias("class"))).select("cluster", "size", "dominant", rounded(F.col("purity")).alias("purity"))


_Z = """v AS (SELECT vec_id AS id, label AS gt, (label + CASE WHEN vec_id % 7 = 0 THEN 1 ELSE 0 END) % 10 AS pred, i AS j, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, (SELECT unnest(range(64)) AS i) AS g),
st AS (SELECT j, avg(x) AS mu, CASE WHEN stddev_pop(x) < 1e-8 THEN 1 ELSE stddev_pop(x) END AS sd FROM v WHERE gt = pred GROUP BY 1),
z AS (SELECT id, gt, pred, v.j, x, (x - mu) / sd AS z FROM v JOIN st USING (j)),
means AS (SELECT gt AS cls, j, avg(z) AS m, avg(x) AS raw, count(*) AS n FROM z WHERE gt = pred GROUP BY 1, 2)"""


@query(f"WITH {_Z} SELECT cls, CAST(j AS INT) AS j, round(m, 4) AS m, round(raw, 4) AS raw, n FROM means")
def class_prototypes(s, d):
    _, means = D.class_means(X.vectors(s, d))
    return means.select("cls", "j", rounded(F.col("m"), 4).alias("m"), rounded(F.col("raw"), 4).alias("raw"), "n")


@query(f"""WITH {_Z}, dd AS (SELECT id, gt, pred, cls, sqrt(sum((z - m) * (z - m))) AS d, max(n) AS n FROM z JOIN means USING (j) WHERE gt <> pred GROUP BY 1, 2, 3, 4),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d, cls) AS rn FROM dd)
SELECT id, gt, pred, CAST(max(CASE WHEN cls = gt THEN n END) AS BIGINT) AS gt_mean_n, round(max(CASE WHEN cls = gt THEN d END), 4) AS dist_gt, round(max(CASE WHEN cls = pred THEN d END), 4) AS dist_pred,
 CASE WHEN max(CASE WHEN cls = pred THEN d END) < max(CASE WHEN cls = gt THEN d END) THEN 'pred' ELSE 'gt' END AS closer_to, CAST(max(CASE WHEN cls = gt THEN rn END) AS INT) AS gt_rank,
 min(CASE WHEN rn = 1 THEN cls END) AS nearest, round(min(d), 4) AS nearest_dist FROM r GROUP BY 1, 2, 3""")
def misdetect_compare(s, d):
    out = D.misdetections(X.vectors(s, d))
    return out.select("id", "gt", "pred", "gt_mean_n", rounded(F.col("dist_gt"), 4).alias("dist_gt"), rounded(F.col("dist_pred"), 4).alias("dist_pred"), "closer_to", "gt_rank", "nearest", rounded(F.col("nearest_dist"), 4).alias("nearest_dist"))


@query(f"WITH {_Z} SELECT CASE WHEN z.j < 16 THEN 'low' ELSE 'high' END AS grp, round(sqrt(avg((z - m) * (z - m))), 4) AS rms, count(*) AS n FROM z JOIN means ON cls = gt AND means.j = z.j WHERE gt <> pred GROUP BY 1")
def misdetect_group_rms(s, d):
    return D.group_rms(X.vectors(s, d), {"low": (0, 16), "high": (16, 64)}).select("grp", rounded(F.col("rms"), 4).alias("rms"), "n")


# --- shapes -------------------------------------------------------------------------------------------------------------------


@query(f"""WITH {X.PX}, {X.FG}, c AS (SELECT stem, CAST(round_even(3.5 - avg(y), 0) AS INT) AS sy, CAST(round_even(3.5 - avg(x), 0) AS INT) AS sx FROM fg GROUP BY 1),
moved AS (SELECT stem, least(greatest(y + sy, 0), 7) - 3.5 AS dy, least(greatest(x + sx, 0), 7) - 3.5 AS dx FROM fg JOIN c USING (stem)),
seen AS (SELECT stem, CAST(least(floor((atan2(dy, dx) + pi()) / (2 * pi()) * 16), 15) AS INT) AS t, max(sqrt(dx * dx + dy * dy)) AS o, min(sqrt(dx * dx + dy * dy)) AS i FROM moved GROUP BY 1, 2),
ext AS (SELECT stem, t + k AS t, o, i FROM seen, (SELECT unnest([-16, 0, 16]) AS k) AS kk),
grid AS (SELECT DISTINCT stem, g FROM seen, (SELECT unnest(range(16)) AS g) AS gg),
a AS (SELECT grid.stem, g, max(ext.t) AS ta FROM grid JOIN ext ON ext.stem = grid.stem AND ext.t <= g GROUP BY 1, 2),
b AS (SELECT grid.stem, g, min(ext.t) AS tb FROM grid JOIN ext ON ext.stem = grid.stem AND ext.t >= g GROUP BY 1, 2)
SELECT a.stem, CAST(a.g AS INT) AS tbin, round(ea.o + (eb.o - ea.o) * CASE WHEN ta = tb THEN 0 ELSE (a.g - ta) / (tb - ta) END, 6) AS r_outer, round(ea.i + (eb.i - ea.i) * CASE WHEN ta = tb THEN 0 ELSE (a.g - ta) / (tb - ta) END, 6) AS r_inner
FROM a JOIN b USING (stem, g) JOIN ext ea ON ea.stem = a.stem AND ea.t = ta JOIN ext eb ON eb.stem = a.stem AND eb.t = tb""")
def polar_profile(s, d):
    return D.polar_profile(X.foreground(s, d), 8, 8, 16).select("stem", F.col("tbin").cast("int").alias("tbin"), rounded(F.col("r_outer")).alias("r_outer"), rounded(F.col("r_inner")).alias("r_inner"))


def _profiles(s, d):
    return X.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda v: v.cast("double") + 1).alias("r"))


_PROF = "p AS (SELECT vec_id AS id, i, CAST(embedding[i + 1] AS DOUBLE) + 1 AS v FROM embeddings, (SELECT unnest(range(64)) AS i) AS g)"


@query(f"""WITH {_PROF} SELECT id, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range,
round(quantile_cont(v, 0.1), 6) AS p10, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.75), 6) AS p75, round(quantile_cont(v, 0.9), 6) AS p90 FROM p GROUP BY 1""")
def profile_stats(s, d):
    out = D.profile_stats(_profiles(s, d))
    return out.select("id", *[rounded(F.col(c)).alias(c) for c in out.columns[1:]])


@query(f"""WITH {_PROF}, f AS (SELECT id, k, sum(v * cos(2 * pi() * ((i * k) % 64) / 64)) AS re, -sum(v * sin(2 * pi() * ((i * k) % 64) / 64)) AS im FROM p, (SELECT unnest(range(1, 9)) AS k) AS kk GROUP BY 1, 2),
g AS (SELECT *, sqrt(re * re + im * im) AS mag, row_number() OVER (PARTITION BY id ORDER BY round(sqrt(re * re + im * im), 9) DESC, k) AS rn FROM f),
z AS (SELECT id, k AS k0, atan2(im, re) / k AS phi FROM g WHERE rn = 1)
SELECT id, CAST(k AS INT) AS k, round(mag / 64, 5) AS mag, round((re * cos(k * phi) + im * sin(k * phi)) / 64, 5) AS phase_re, round((im * cos(k * phi) - re * sin(k * phi)) / 64, 5) + 0 AS phase_im FROM g JOIN z USING (id)""")
def fourier_descriptor(s, d):
    out = D.fourier(_profiles(s, d), 8)
    return out.select("id", "k", *[rounded(F.col(c), 5).alias(c) for c in ("mag", "phase_re", "phase_im")])


@query("SELECT vec_id AS id, CAST(CASE WHEN vec_id % 64 >= 32 THEN vec_id % 64 - 64 ELSE vec_id % 64 END AS INT) AS shift FROM embeddings")
def circular_register(s, d):
    p = _profiles(s, d).select("id", F.col("r").alias("ref"), F.pmod("id", F.lit(64)).cast("int").alias("by"))
    rolled = F.when(F.col("by") == 0, F.col("ref")).otherwise(F.concat(F.slice("ref", 65 - F.col("by"), F.col("by")), F.slice("ref", F.lit(1), 64 - F.col("by"))))
    return D.best_shift(p.select("id", "ref", rolled.alias("r"))).select("id", F.col("shift").cast("int").alias("shift"))


@query(f"""WITH {X.PX}, {X.FG}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY stem) AS dx, y - avg(y) OVER (PARTITION BY stem) AS dy FROM fg),
m AS (SELECT stem, sum(dx * dx * dx) AS a, sum(dy * dy * dy) AS b, sum(dx * dx * dy) AS c, sum(dx * dy * dy) AS d FROM c GROUP BY 1)
SELECT stem, round(sign(a) * ln(1 + abs(a)), 5) + 0 AS mu30, round(sign(b) * ln(1 + abs(b)), 5) + 0 AS mu03, round(sign(c) * ln(1 + abs(c)), 5) + 0 AS mu21, round(sign(d) * ln(1 + abs(d)), 5) + 0 AS mu12 FROM m""")
def signed_moments(s, d):
    out = D.signed_moments(X.foreground(s, d))
    return out.select("stem", *[rounded(F.col(c), 5).alias(c) for c in out.columns[1:]])


@query()
def embedding_pca(s, d):
    return D.zscore_pca(X.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")))


# --- edges, shapes and models in array form (rows only) ---------------------------------------------------------------


@query()
def canny_edge(s, d):
    return _fg(G.edges(X.raster(s, d)))


@query()
def contour_fill(s, d):
    return _fg(G.fill_edges(X.mask(s, d), low=1.0))


@query()
def shape_features(s, d):
    from fieldloom.operators.shape import shape_vectors

    return shape_vectors(X.mask(s, d))


@query()
def sample_features(s, d):
    from fieldloom.operators.shape import sample_vectors

    return sample_vectors(X.mask(s, d))


@query()
def segment_with_hole_stub(s, d):
    from fieldloom.operators.model import BoxThreshold, HoleConfig, segment

    _, obj = _objects(s, d)
    return segment(X.raster(s, d), obj, lambda: BoxThreshold(), min_area=2, holes=HoleConfig(hole_seed_rim=3, hole_edge_margin=1, hole_edge_close=2, hole_edge_thick=1, hole_open_size=1))


# --- flows and streams ------------------------------------------------------------------------------------------------------


@query(f"WITH {X.PX}, {X.FG} SELECT stem, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM fg GROUP BY 1")
def flow_frame_unit(s, d):
    from .flow import Flow, run_flow

    flow = Flow(unit="frame", processes=[{"op": "threshold_score", "k": 160, "inputs": {"dist": "frame"}}, {"op": "mask_box", "outputs": {"bbox": {"to": "meta", "level": "frame"}}}])
    out = run_flow(flow, frames=X.raster(s, d).withColumnRenamed("data", "frame"))
    return out.tables["bbox"].select("stem", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


@query(f"WITH RECURSIVE {_OBJ} SELECT stem, obj_id, CAST(count(*) AS BIGINT) AS area FROM obj JOIN px USING (stem) WHERE v > 160 AND x >= round_even(x0, 0) AND x < round_even(x1, 0) AND y >= round_even(y0, 0) AND y < round_even(y1, 0) GROUP BY 1, 2")
def flow_object_unit(s, d):
    from .flow import Flow, run_flow

    _, obj = _objects(s, d)
    flow = Flow(unit="object", processes=[{"op": "threshold_score", "k": 160, "inputs": {"dist": "frame"}}, {"op": "box_area", "outputs": {"area": {"to": "meta"}}}])
    out = run_flow(flow, frames=X.raster(s, d).withColumnRenamed("data", "frame"), objects=obj)
    return out.tables["area"].select("stem", F.col("obj_id").cast("int").alias("obj_id"), F.col("area").cast("long").alias("area"))


@query(f"""WITH {X.PX}, hist AS (SELECT 1 AS one, v AS bin, count(*) AS w FROM px GROUP BY ALL), {X.robust_sql('hist', 'one', 256, False)} SELECT 'mean_c0' AS name, mu AS value FROM stats UNION ALL SELECT 'std_c0', round(sigma, 6) FROM stats""")
def flow_carry_finalize(s, d):
    from .flow import Flow, run_flow

    flow = Flow(unit="frame", processes=[{"op": "accumulate_histogram", "inputs": {"image": "frame"}}], carry=["acc"], finalize_processes=[{"op": "robust_stats", "bins": 256, "outputs": {"mean_c0": {"to": "meta"}, "std_c0": {"to": "meta"}}}])
    out = run_flow(flow, frames=X.raster(s, d).withColumnRenamed("data", "frame"))
    return out.params.select("name", rounded(F.col("value")).alias("value"))


@query("""SELECT event_type, CAST(least(greatest(floor(value), 0), 255) AS INT) AS bin, count(*) AS w FROM events GROUP BY 1, 2""")
def stream_hist_equals_batch(s, d):
    from fieldloom.streaming.histograms import stream_histogram

    return stream_histogram(s, f"{d}/events.parquet")

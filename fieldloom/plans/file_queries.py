"""Registered queries over image formats, data sources and resampled rasters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import expressions as E
from fieldloom.functions.expressions import rounded
from fieldloom.operators import catalog as C
from fieldloom.operators import raster as R
from fieldloom.operators import regions as G
from fieldloom.sources import converters as V
from fieldloom.sources import discover as S
from fieldloom.sources import sinks as K
from fieldloom.sources.scratch import Scratch
from fieldloom.streaming.accumulators import StreamingAccumulator
from fieldloom.streaming.histograms import histogram_of

from . import fixtures as X
from .queries import _fg, query


def _as_files(s, d, fmt):
    return K.encoded(X.raster(s, d), fmt)


@query(f"WITH {X.PX} SELECT f AS fmt, stem, y, x, v FROM px, (SELECT unnest(['bmp', 'png', 'tif']) AS f) AS formats")
def image_formats_round_trip(s, d):
    """Rasters as files of each lossless format and back."""
    back = [R.to_pixels(S.decoded_images(_as_files(s, d, f), "stem")).select(F.lit(f).alias("fmt"), "stem", "y", "x", "v") for f in ("bmp", "png", "tif")]
    return reduce(DataFrame.union, back)


@query(f"WITH {X.PX} SELECT stem, CAST(count(*) AS BIGINT) AS pixels, true AS near FROM px GROUP BY stem")
def image_jpeg_round_trip(s, d):
    """Rasters as JPEG files and back: how many pixels are compared, and that none is off by over 12 of 255 at the usual quality."""
    was, back = X.pixels(s, d).select("stem", "y", "x", "v"), R.to_pixels(S.decoded_images(_as_files(s, d, "jpg"), "stem")).select("stem", "y", "x", F.col("v").alias("w"))
    return was.join(back, ["stem", "y", "x"]).groupBy("stem").agg(F.count("*").alias("pixels"), (F.max(F.abs(F.col("v") - F.col("w"))) <= 12).alias("near"))


@query(f"WITH {X.PX} SELECT stem, y, x, v FROM px")
def segmap_first_channel(s, d):
    """Label maps from colour files: their first channel."""
    three = X.raster(s, d).withColumn("data", F.flatten(F.transform("data", lambda v: F.array(v, 255 - v, F.lit(7))))).withColumn("channels", F.lit(3))
    return R.to_pixels(S.decoded_segmaps(K.encoded(three, "bmp"), "stem")).select("stem", "y", "x", "v")


@query("""SELECT CAST(doc_id AS VARCHAR) AS stem, '' AS path, 'lang' AS name, '"' || lang || '"' AS value FROM documents WHERE lang IS NOT NULL
UNION ALL SELECT CAST(doc_id AS VARCHAR), '', 'n_chars', CAST(n_chars AS VARCHAR) FROM documents WHERE n_chars IS NOT NULL
UNION ALL SELECT CAST(doc_id AS VARCHAR), '0', 'bbox', '{"x0":0,"x1":' || n_chars || ',"y0":' || doc_id || ',"y1":1}' FROM documents WHERE n_chars IS NOT NULL""")
def annotation_lines(s, d):
    """Documents as annotation lines, written by Spark and read by the data source in splits."""
    t, scratch = X.table(s, d, "documents"), Scratch(s, "lines")
    box = F.when(F.col("n_chars").isNotNull(), F.array(F.struct(F.array(F.lit(0), F.col("doc_id"), F.col("n_chars"), F.lit(1)).alias("bbox"))))
    t.select(F.col("doc_id").cast("string").alias("stem"), F.struct("lang", "n_chars").alias("leaves"), box.alias("objects")).write.json(scratch.path)
    rows = V.convert(s, {"object_type": "lines", "sources": [scratch.path], "split": 1 << 20})
    return rows.select("stem", F.array_join("path", "/").alias("path"), "name", "value")


@query(f"WITH {X.PX} SELECT stem, y, x, v FROM px")
def payload_sink(s, d):
    """Rasters written as files by the payload sink, listed and read back by Spark."""
    scratch = Scratch(s, "payloads")
    K.write_files(_as_files(s, d, "tif"), scratch.path, "tif")
    found = S.read_images(s, scratch.path, "*.tif")
    return R.to_pixels(found.withColumn("stem", F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("bigint"))).select("stem", "y", "x", "v")


# --- resampling ----------------------------------------------------------------------------------------------------------


def _resize_sql(m: int, method: str) -> str:
    """8 x 8 frames at m x m: the weights of each axis as a table, joined twice."""
    place = f"least(greatest((i + 0.5::DOUBLE) * 8 / {m} - 0.5, 0), 7)"
    weight = f"greatest(0, 1 - abs({place} - k))" if method == "linear" else f"greatest(0, least((i + 1) * 8::DOUBLE / {m}, k + 1) - greatest(i * 8::DOUBLE / {m}, k)) * {m} / 8"
    return f"""ax AS (SELECT i, k, {weight} AS w FROM (SELECT unnest(range({m})) AS i), (SELECT unnest(range(8)) AS k)),
big AS (SELECT stem, CAST(a.i AS INT) AS y, CAST(b.i AS INT) AS x, CAST(floor(round(sum(v * a.w * b.w), 9) + 0.5) AS INT) AS v FROM px JOIN ax a ON a.k = y JOIN ax b ON b.k = x WHERE a.w > 0 AND b.w > 0 GROUP BY ALL)"""


@query(f"WITH {X.PX}, {_resize_sql(12, 'linear')} SELECT stem, y, x, v FROM big")
def resize_linear(s, d):
    return R.to_pixels(R.resized(X.raster(s, d), 12, 12)).select("stem", "y", "x", "v")


@query(f"WITH {X.PX}, {_resize_sql(5, 'area')} SELECT stem, y, x, v FROM big")
def resize_area(s, d):
    return R.to_pixels(R.resized(X.raster(s, d), 5, 5, "area")).select("stem", "y", "x", "v")


@query(f"WITH {X.PX}, {_resize_sql(12, 'linear')} SELECT stem, y, x, CAST(floor((v + y * 12 + x) / 2.0) AS INT) AS v FROM big")
def blend_sizes(s, d):
    """A 12 x 12 ramp, then the 8 x 8 frame at its size, half and half."""
    small = X.raster(s, d).select("stem", F.lit(1).alias("place"), "h", "w", "data")
    ramp = small.select("stem", F.lit(0).alias("place"), F.lit(12).alias("h"), F.lit(12).alias("w"), F.sequence(F.lit(0), F.lit(143)).alias("data"))
    return R.to_pixels(R.blend_frames(small.union(ramp))).select("stem", "y", "x", "v")


# --- colours and seeds ---------------------------------------------------------------------------------------------------

_LAB = """l AS (SELECT stem, y, x, v AS a, c1 AS b, (128 * 100::DOUBLE / 255 + 16) / 116 AS fy FROM px), t AS (SELECT *, fy + (a - 128) / 500::DOUBLE AS fx, fy - (b - 128) / 200::DOUBLE AS fz FROM l),
u AS (SELECT *, 0.950456::DOUBLE * CASE WHEN fx ** 3 > 0.008856 THEN fx ** 3 ELSE (fx - 16::DOUBLE / 116) / 7.787 END AS xx, CASE WHEN fy ** 3 > 0.008856 THEN fy ** 3 ELSE (fy - 16::DOUBLE / 116) / 7.787 END AS yy, 1.088754::DOUBLE * CASE WHEN fz ** 3 > 0.008856 THEN fz ** 3 ELSE (fz - 16::DOUBLE / 116) / 7.787 END AS zz FROM t)"""
_OUT = lambda c: f"CAST(least(greatest(floor(255 * CASE WHEN {c} <= 0.0031308 THEN 12.92::DOUBLE * ({c}) ELSE 1.055::DOUBLE * greatest({c}, 0) ** (1 / 2.4::DOUBLE) - 0.055 END + 0.5), 0), 255) AS INT)"


@query(f"""WITH {X.PX}, {_LAB} SELECT stem, y, x, {_OUT("0.055648::DOUBLE * xx - 0.204043::DOUBLE * yy + 1.057311::DOUBLE * zz")} AS blue, {_OUT("-0.969256::DOUBLE * xx + 1.875991::DOUBLE * yy + 0.041556::DOUBLE * zz")} AS green, {_OUT("3.240479::DOUBLE * xx - 1.537150::DOUBLE * yy - 0.498535::DOUBLE * zz")} AS red FROM u""")
def chroma_inverse_lab(s, d):
    b, g, r = E.lab_ab_to_bgr(F.col("v"), F.col("c1"))
    return X.pixels(s, d).select("stem", "y", "x", b.alias("blue"), g.alias("green"), r.alias("red"))


_SEED = f"""{X.PX}, bw AS (SELECT stem, y, x, CASE WHEN v > 100 THEN 1 ELSE 0 END AS v FROM px), {X.sweep_sql('bw', 'er', 3, 'min')}, m AS (SELECT px.*, er.v AS deep FROM px JOIN er USING (stem, y, x) WHERE px.v > 100),
rim AS (SELECT * FROM (SELECT *, count(*) FILTER (deep = 0) OVER (PARTITION BY stem) AS n FROM m) WHERE n <= 50 OR deep = 0),
st AS (SELECT stem, avg(c0) AS m0, avg(c1) AS m1, coalesce(var_samp(c0), 0) + 1 AS a, coalesce(covar_samp(c0, c1), 0) AS b, coalesce(var_samp(c1), 0) + 1 AS c, quantile_cont(c1, 0.3) AS dark FROM rim GROUP BY 1),
z AS (SELECT m.*, dark, sqrt(((c0 - m0) * (c0 - m0) * c - 2 * (c0 - m0) * (c1 - m1) * b + (c1 - m1) * (c1 - m1) * a) / (a * c - b * b)) AS far, quantile_cont(c1, 0.8) OVER (PARTITION BY stem) AS shine, quantile_cont((c0 + c1) / 2.0, 0.7) OVER (PARTITION BY stem) AS mean_shine FROM m JOIN st USING (stem)),
s1 AS (SELECT stem, y, x FROM z WHERE (far > 1.75 OR c1 < dark) AND c1 <= shine),
w AS (SELECT z.stem, z.y, z.x, CASE WHEN z.y + i < 0 THEN -(z.y + i) WHEN z.y + i > 7 THEN 14 - (z.y + i) ELSE z.y + i END AS yy, CASE WHEN z.x + j < 0 THEN -(z.x + j) WHEN z.x + j > 7 THEN 14 - (z.x + j) ELSE z.x + j END AS xx FROM s1 z, (SELECT unnest([-1, 0, 1]) AS i) AS p, (SELECT unnest([-1, 0, 1]) AS j) AS q)"""


@query(f"""WITH {_SEED} SELECT 'lab' AS kind, w.stem, w.y, w.x FROM w JOIN s1 ON s1.stem = w.stem AND s1.y = yy AND s1.x = xx GROUP BY ALL HAVING count(*) >= 4
UNION ALL SELECT 'rgb', stem, y, x FROM z WHERE far > 1.25 AND (c0 + c1) / 2.0 <= mean_shine""")
def colour_seed_options(s, d):
    """Seeds with the boost of dark pixels, without highlights and lone ones; and in a space without a brightness of its own, where nothing is boosted."""
    r = X.raster(s, d).withColumn("c0", F.transform("data", lambda v: F.floor(v * 180 / 256).cast("int"))).withColumn("c1", F.reverse("data"))
    r = r.withColumn("data", F.transform("data", lambda v: F.when(v > 100, 255).otherwise(0)))
    own = dict(rim_px=3, dark_boost=True, dark_pct=30)
    lab = G.colour_seed(r, ["c0", "c1"], "c1", color_thr=1.75, highlight_pct=80, dense_win=3, dense_min=4, **own)
    rgb = G.colour_seed(r, ["c0", "c1"], None, color_thr=1.25, highlight_pct=70, **own)
    return _fg(lab).select(F.lit("lab").alias("kind"), "*").union(_fg(rgb).select(F.lit("rgb").alias("kind"), "*"))


# --- typed values of the catalogue ---------------------------------------------------------------------------------------


def _typed(s, d):
    t = X.table(s, d, "documents")
    text = lambda n, *c: F.struct(F.lit(n).alias("name"), F.concat(*[F.lit(x) if isinstance(x, str) else x for x in c]).alias("value"))
    i, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    leaves = F.array(text("n", n), text("lang", '"', F.col("lang"), '"'), text("pair", "[", i, ",", n, "]"), text("deep", '{"a":{"b":', n, '},"c":"', i, '"}'), text("torn", "{", i))
    rows = t.select(F.lit("modified").alias("category"), i.alias("stem"), F.array().cast("array<string>").alias("path"), F.explode(leaves).alias("l"))
    return rows.select("category", "stem", "path", "l.name", F.lit("attr").alias("type"), F.lit("str").alias("format"), "l.value")


@query("SELECT CAST(doc_id AS VARCHAR) AS stem, n_chars AS n, n_chars AS second, n_chars AS b, '[' || doc_id || ',' || n_chars || ']' AS whole, CAST(-1 AS BIGINT) AS torn, CAST(NULL AS BIGINT) AS misfit FROM documents")
def attr_typed(s, d):
    """Numbers, places in lists and objects, and whole values, read by their types."""
    refs, out = _typed(s, d), None
    for alias, name, kind, path, default in (("n", "n", "long", "$", None), ("second", "pair", "long", "$[1]", None), ("b", "deep", "long", "$.a.b", None), ("whole", "pair", "string", "$", None), ("torn", "torn", "long", "$", -1), ("misfit", "lang", "long", "$", None)):
        own = C.attr(refs, name, default, kind, path).withColumnRenamed("value", alias)
        out = own if out is None else out.join(own, "stem")
    return out


@query("""SELECT 'n' AS name, 'BIGINT' AS kind, count(*) AS n FROM documents UNION ALL SELECT 'lang', 'STRING', count(*) FROM documents UNION ALL SELECT 'pair', 'ARRAY<BIGINT>', count(*) FROM documents
UNION ALL SELECT 'deep', 'OBJECT<a: OBJECT<b: BIGINT>, c: STRING>', count(*) FROM documents""")
def attr_kinds(s, d):
    return C.attr_kinds(_typed(s, d).where("name <> 'torn'"))


# --- streams ---------------------------------------------------------------------------------------------------------------


@query(f"WITH hist AS (SELECT event_type, CAST(least(greatest(floor(value), 0), 255) AS INT) AS bin, count(*) AS w FROM events GROUP BY 1, 2), {X.robust_sql('hist', 'event_type', 256, False)} SELECT event_type, mu, round(sigma, 6) AS sigma FROM stats")
def stream_params_restart(s, d):
    """Params of an accumulator whose stream stops half way and goes on from its folder."""
    scratch, half = Scratch(s, "stream"), F.pmod(F.xxhash64("event_id"), F.lit(2))
    events = X.table(s, d, "events")
    for i in range(2):
        events.where(half == i).select("event_type", "value").write.mode("append").parquet(f"{scratch.path}/in")
        rows = s.readStream.schema("event_type string, value double").parquet(f"{scratch.path}/in")
        acc = StreamingAccumulator(s, f"{scratch.path}/state", histogram_of, lambda h: R.robust_stats(h, ["event_type"], 256, False))
        acc.start(rows).awaitTermination()
    return acc.latest().select("event_type", "mu", rounded(F.col("sigma")).alias("sigma"))


# --- overlays ------------------------------------------------------------------------------------------------------------


@query(f"""WITH {X.PX}, ch AS (SELECT stem, y, x, v, unnest([0, 1, 2]) AS c FROM px), base AS (SELECT stem, y, x, v AS own, c, CASE c WHEN 0 THEN v WHEN 1 THEN 255 - v ELSE 7 END AS v FROM ch),
one AS (SELECT *, CASE WHEN own > 160 THEN CAST(floor(0.55::DOUBLE * v + 0.45::DOUBLE * [200, 10, 0][c + 1]) AS INT) ELSE v END AS v1 FROM base), two AS (SELECT *, CASE WHEN own < 90 THEN CAST(floor(0.55::DOUBLE * v1 + 0.45::DOUBLE * [0, 0, 255][c + 1]) AS INT) ELSE v1 END AS v2 FROM one),
depth AS (SELECT *, least(x - 1, 6 - x, y - 0, 5 - y) AS d FROM two)
SELECT stem, y, x, c, CASE WHEN d IN (0, 1) THEN [200, 10, 0][c + 1] ELSE v2 END AS v FROM depth""")
def overlay_layers(s, d):
    """Two masks mixed into colour frames, the second over the first, and a box around the first."""
    r = X.raster(s, d).select("stem", "h", "w", F.lit(3).alias("channels"), F.flatten(F.transform("data", lambda v: F.array(v, 255 - v, F.lit(7)))).alias("data"), F.col("data").alias("grey"))
    mask = lambda on: F.transform("grey", lambda v: F.when(on(v), 255).otherwise(0))
    box = F.struct(F.lit(1.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(6.0).alias("x1"), F.lit(5.0).alias("y1"))
    layer = lambda place, colour, m, b: F.struct(F.lit(place).alias("place"), F.array(*map(F.lit, colour)).alias("colour"), m.alias("mask"), b.alias("bbox"))
    layers = r.select("stem", F.explode(F.array(layer(2, (0, 0, 255), mask(lambda v: v < 90), F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>")), layer(1, (200, 10, 0), mask(lambda v: v > 160), box))).alias("l")).select("stem", "l.*")
    out = R.composed(r, layers).select("stem", "w", F.posexplode("data").alias("i", "v"))
    return out.select("stem", F.expr("cast(i div 3 div w as int)").alias("y"), F.expr("cast(i div 3 % w as int)").alias("x"), F.expr("cast(i % 3 as int)").alias("c"), "v")

"""Registered queries over sources, sinks, flows and models, each with its SQL oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from fieldloom.functions import expressions as E
from fieldloom.functions.expressions import rounded
from fieldloom.operators import catalog as C
from fieldloom.operators import diagnostics as D
from fieldloom.operators import raster as R
from fieldloom.operators import regions as G
from fieldloom.operators.history import EditHistory
from fieldloom.sources import discover as S
from fieldloom.sources import sinks as K

from . import fixtures as X
from .queries import _CC, _OBJ, _RLE, _fg, _objects, query

_REFS = X.catalog_sql()

# --- sources: listings and payloads made of the driver's tables --------------------------------------------------------


def _paths(table, column, head, tail):
    return table.select(F.concat(F.lit(head), F.col(column).cast("string"), F.lit(tail)).alias("path"))


@query("""SELECT 'modified' AS category, CAST(d.doc_id AS VARCHAR) AS stem, n AS name, CASE n WHEN 'frame' THEN 'image' ELSE 'attr' END AS type, CASE n WHEN 'frame' THEN 'png' ELSE 'txt' END AS format,
 '{"dir":"/d/' || d.doc_id || CASE n WHEN 'frame' THEN '_pose.png' ELSE '_kind.txt' END || '"}' AS value FROM documents d JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id), (SELECT unnest(['frame', 'kind']) AS n) AS names
UNION ALL SELECT NULL, NULL, 'part-' || p_partkey, 'array', 'npy', '{"dir":"/p/part-' || p_partkey || '.npy"}' FROM part""")
def convert_catalog(s, d):
    frames, kinds = _paths(X.table(s, d, "documents"), "doc_id", "/d/", "_pose.png"), _paths(X.table(s, d, "labels"), "doc_id", "/d/", "_kind.txt")
    found = S.discover(s, [frames.union(kinds)], {"frame": "*_pose.png", "kind": {"pattern": "*_kind.txt", "type": "attr"}}, _paths(X.table(s, d, "part"), "p_partkey", "/p/part-", ".npy"))
    return found.select("category", "stem", "name", "type", "format", "value")


@query("""SELECT CAST(vec_id AS VARCHAR) AS stem, CASE WHEN vec_id % 5 = 0 THEN '__unlabeled__' ELSE 'c' || label END AS class_id FROM embeddings""")
def mask_folders(s, d):
    e = X.table(s, d, "embeddings")
    folder = F.when(F.col("vec_id") % 5 == 0, "").otherwise(F.concat(F.lit("c"), F.col("label").cast("string"), F.lit("/")))
    return S.mask_files(s, "/masks", e.select(F.concat(F.lit("/masks/"), folder, F.col("vec_id").cast("string"), F.lit(".png")).alias("path"))).select("stem", "class_id")


@query("""SELECT CASE WHEN doc_id % 2 = 0 THEN 'staged' ELSE 'modified' END AS category, CAST(doc_id AS VARCHAR) AS stem, '7' AS path, 'n' AS name, 'attr' AS type, CAST(n_chars AS VARCHAR) AS value FROM documents WHERE doc_id % 10 <> 3""")
def sidecar_load(s, d):
    """Every tenth sidecar is torn, which counts as absent."""
    t = X.table(s, d, "documents")
    whole = F.concat(F.lit('{"type":"stem","info":{"7":{"type":"stem","info":{"n":{"type":"attr","info":{"value":'), F.col("n_chars").cast("string"), F.lit("}}}}}}"))
    files = t.select(F.concat(F.lit("/set/"), F.when(F.col("doc_id") % 2 == 0, "staged").otherwise("modified"), F.lit("/.meta/"), F.col("doc_id").cast("string"), F.lit(".json")).alias("path"), F.when(F.col("doc_id") % 10 == 3, F.substring(whole, 1, 20)).otherwise(whole).alias("body"))
    return S.sidecar_rows(files).select("category", "stem", F.array_join("path", "/").alias("path"), "name", "type", "value")


@query(f"WITH {X.PX} SELECT stem, y, x, v FROM px")
def image_round_trip(s, d):
    """Rasters as PNG files and back."""
    return R.to_pixels(S.decoded_images(K.encoded(X.raster(s, d), "png"), "stem")).select("stem", "y", "x", "v")


@query(f"WITH {X.PX} SELECT stem, CAST(8 AS BIGINT) AS h, CAST(8 AS BIGINT) AS w, CAST(sum(v * (y * 8 + x)) AS DOUBLE) AS weighted FROM px GROUP BY 1")
def array_round_trip(s, d):
    """Rasters as NPY files and back; the weighted sum tells every place."""
    back = S.decoded_arrays(K.encoded(X.raster(s, d), "npy"), "stem")
    weighted = F.aggregate(F.transform("data", lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return back.select("stem", F.col("shape")[0].alias("h"), F.col("shape")[1].alias("w"), weighted.alias("weighted"))


@query(f"WITH {X.PX} SELECT 'l' || label AS path, CAST(sum(v) AS DOUBLE) AS total FROM px GROUP BY label ORDER BY total DESC, path LIMIT 1")
def largest_accumulator(s, d):
    own = X.pixels(s, d).groupBy("label", "y", "x").agg(F.sum("v").cast("double").alias("n")).groupBy("label").agg(F.collect_list("n").alias("data"))
    arrays = own.select(F.concat(F.lit("l"), F.col("label").cast("string")).alias("path"), F.array(F.lit(8), F.lit(8), F.lit(1)).cast("array<bigint>").alias("shape"), "data")
    return S.pick_accumulator(arrays).select("path", "total")


@query("SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS value FROM documents")
def attr_payload(s, d):
    return X.table(s, d, "documents").select("doc_id", S.attr_text(F.encode("text", "UTF-8")).alias("value"))


_IDS = {"en": {"train": 0, "review": 7}, "de": {"train": 1}, "fr": {"train": 2}}


@query("SELECT CAST(doc_id AS VARCHAR) AS stem, lang AS class_id, CAST(CASE lang WHEN 'en' THEN 0 WHEN 'de' THEN 1 WHEN 'fr' THEN 2 END AS INT) AS id FROM documents")
def class_ids(s, d):
    return S.with_ids(X.catalog(s, d), S.id_map(s, _IDS), "train", "lang")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events")
def json_map_attr(s, d):
    return X.table(s, d, "events").select("event_id", F.from_json("props", "map<string,int>")["k"].alias("k"))


# --- catalogue and sinks -------------------------------------------------------------------------------------------------


@query(f"WITH {_REFS} SELECT category, stem, name, value FROM refs WHERE stem = '7'")
def catalog_find(s, d):
    return C.find(X.catalog(s, d), "7").select("category", "stem", "name", "value")


@query(f"WITH {X.PX}, {X.FG} SELECT 'modified' AS category, CAST(stem AS VARCHAR) AS stem, '' AS path, 'bbox' AS name, 'attr' AS type, '{{\"x0\":' || min(x) || ',\"y0\":' || min(y) || ',\"x1\":' || max(x) + 1 || ',\"y1\":' || max(y) + 1 || '}}' AS value FROM fg GROUP BY stem")
def route_attribute(s, d):
    boxes = R.bbox(X.foreground(s, d), ["stem"]).select("stem", F.struct("x0", "y0", "x1", "y1").alias("bbox"))
    return K.routed(boxes, "bbox", level="frame").select("category", "stem", F.array_join("path", "/").alias("path"), "name", "type", "value")


@query(f"WITH {_RLE} SELECT CAST(stem AS VARCHAR) AS stem, 'rle' AS type, '{{\"size\":[8,8],\"counts\":[' || string_agg(CAST(n AS VARCHAR), ',' ORDER BY k, i) || ']}}' AS value FROM runs WHERE n IS NOT NULL GROUP BY 1")
def route_raster(s, d):
    return K.routed(X.mask(s, d).withColumnRenamed("data", "mask"), "mask", level="frame").select("stem", "type", "value")


@query("SELECT CAST(doc_id AS VARCHAR) AS stem, '/set/' || CASE WHEN doc_id % 2 = 0 THEN 'staged' ELSE 'modified' END || '/view/' || doc_id || '.png' AS file FROM documents")
def payload_places(s, d):
    refs = X.catalog(s, d).where("name = 'lang'").select("category", "stem", "path", F.lit("frame").alias("name"), F.lit("image").alias("type"), F.lit("png").alias("format"), F.lit('{"dir":"view"}').alias("value"))
    return K.payloads(refs, "/set").select("stem", "file")


@query("SELECT '/set/modified/view/' || doc_id || '.png' AS source, '/set/staged/view/' || doc_id || '.png' AS target FROM documents WHERE doc_id % 2 = 1 AND doc_id % 6 = 1")
def payload_moves(s, d):
    refs = X.catalog(s, d).where("name = 'lang'").select("category", "stem", "path", F.lit("frame").alias("name"), F.lit("image").alias("type"), F.lit("png").alias("format"), F.lit('{"dir":"view"}').alias("value"))
    stems = X.table(s, d, "documents").where("doc_id % 6 = 1").select(F.col("doc_id").cast("string").alias("stem"))
    return K.payload_moves(refs, stems, "staged", "/set")


@query("""SELECT stem, path, name FROM (SELECT CAST(doc_id AS VARCHAR) AS stem, doc_id, '' AS path, n AS name FROM documents, (SELECT unnest(['lang', 'source']) AS n) AS x
UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id, '0', 'old' FROM documents WHERE doc_id % 4 <> 0 UNION ALL SELECT CAST(doc_id AS VARCHAR), doc_id, '0', 'new' FROM documents WHERE doc_id % 4 = 0)""")
def replace_objects(s, d):
    refs = X.catalog(s, d)
    of = lambda t, name: t.select(F.lit("modified").alias("category"), F.col("doc_id").cast("string").alias("stem"), F.array(F.lit("0")).alias("path"), F.lit(name).alias("name"), F.lit("attr").alias("type"), F.lit("str").alias("format"), F.lit("1").alias("value"))
    docs = X.table(s, d, "documents")
    return K.replace_objects(refs.unionByName(of(docs, "old")), of(docs.where("doc_id % 4 = 0"), "new")).select("stem", F.array_join("path", "/").alias("path"), "name")


@query(f"WITH {X.PX}, {X.FG}, {X.OTHER} SELECT * FROM fg INTERSECT SELECT * FROM other")
def undo_history(s, d):
    """Two edits, undo, undo, redo, and one undo at the end of the stack too many."""
    fg, other = X.foreground(s, d), X.other_mask(s, d)
    h = EditHistory(fg)
    h.commit(R.combine(fg, other, "intersect"))
    h.commit(R.combine(fg, other, "union"))
    for step in (h.undo, h.undo, h.undo, h.redo):
        step()
    return h.current


# --- masks and components --------------------------------------------------------------------------------------------------


@query(f"WITH RECURSIVE {_CC} SELECT stem, y, x FROM cc WHERE label = 2")
def object_mask(s, d):
    return R.object_mask(R.to_pixels(G.components(X.mask(s, d)), "label"), 1).select("stem", "y", "x")


@query(f"WITH {X.PX} SELECT stem, y, x, CAST(CASE WHEN v / 255.0 > 0.5 THEN 255 ELSE 0 END AS INT) AS v FROM px")
def mask_binary(s, d):
    return X.pixels(s, d).select("stem", "y", "x", R.binary(F.col("v") / 255.0).cast("int").alias("v"))


@query(f"""WITH {X.PX}, {X.FG}, box AS (SELECT stem, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM fg GROUP BY 1), sq AS (SELECT stem, (x0 + x1) // 2 AS cx, (y0 + y1) // 2 AS cy, greatest(x1 - x0 + 1, y1 - y0 + 1) AS side FROM box),
cut AS (SELECT stem, y - (cy - side // 2) AS y, x - (cx - side // 2) AS x, side FROM fg JOIN sq USING (stem))
SELECT stem, CAST(y + (12 - side) // 2 AS INT) AS y, CAST(x + (12 - side) // 2 AS INT) AS x, CAST(12 AS INT) AS side FROM cut WHERE y >= 0 AND x >= 0 AND y < side AND x < side""")
def normalize_mask(s, d):
    return R.normalize_mask(X.foreground(s, d), 12)


@query("SELECT vec_id AS idx, CAST(floor(vec_id * 180 * CAST(0.6180339887498949 AS DOUBLE)) AS INT) % 180 AS hue FROM embeddings")
def palette(s, d):
    return X.table(s, d, "embeddings").select(F.col("vec_id").alias("idx"), E.palette_hue(F.col("vec_id")).alias("hue"))


@query(f"""WITH RECURSIVE {X.PX}, free AS (SELECT stem, y, x FROM px WHERE v <= 110),
flood AS (SELECT stem, y, x FROM free WHERE y = 0 AND x = 0 UNION SELECT b.stem, b.y, b.x FROM flood a JOIN free b ON a.stem = b.stem AND abs(a.y - b.y) + abs(a.x - b.x) = 1)
SELECT stem, y, x FROM px WHERE v > 110 UNION ALL (SELECT * FROM free EXCEPT SELECT * FROM flood)""")
def fill_holes(s, d):
    return _fg(G.fill_holes(X.mask(s, d, 110)))


_GROWN = f"{X.PX}, b AS (SELECT stem, y, x, CASE WHEN v > 100 THEN 1 ELSE 0 END AS v FROM px), {X.sweep_sql('b', 'er', 2, 'min')}, {X.sweep_sql('er', 'op', 2, 'max')}, m AS (SELECT stem, y, x FROM op WHERE v = 1), {X.COMPONENTS}"


@query(f"WITH RECURSIVE {_GROWN}, seeds AS (SELECT DISTINCT stem, cc.label FROM cc JOIN px USING (stem, y, x) WHERE px.v > 190) SELECT stem, y, x FROM cc JOIN seeds USING (stem, label)")
def hole_finalize(s, d):
    seed = F.transform(F.col("data"), lambda v: F.when(v > 190, 255).otherwise(0))
    return _fg(G.finalize(X.raster(s, d).withColumn("seed", seed).withColumn("data", F.transform("data", lambda v: F.when(v > 100, 255).otherwise(0))), 2))


@query(f"""WITH {X.PX}, {X.FG}, n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY y, x) - 1 AS at, count(*) OVER (PARTITION BY stem) AS n FROM fg),
w AS (SELECT stem, i, n, least(5, n) AS m FROM (SELECT DISTINCT stem, n FROM n), (SELECT unnest(range(5)) AS i) AS g WHERE i < n)
SELECT w.stem, CAST(i AS INT) AS i, x, y FROM w JOIN n ON n.stem = w.stem AND n.at = CASE WHEN m > 1 THEN floor(i * (w.n - 1) / (m - 1)) ELSE 0 END""")
def spread_points(s, d):
    return G.spread_points(X.mask(s, d), 5)


@query(f"""WITH {X.PX}, b AS (SELECT stem, y, x, CASE WHEN v > 100 THEN 1 ELSE 0 END AS v FROM px), {X.sweep_sql('b', 'er', 7, 'min')}, m AS (SELECT px.*, er.v AS deep FROM px JOIN er USING (stem, y, x) WHERE px.v > 100),
rim AS (SELECT * FROM (SELECT *, count(*) FILTER (deep = 0) OVER (PARTITION BY stem) AS n FROM m) WHERE n <= 50 OR deep = 0),
st AS (SELECT stem, avg(c0) AS m0, avg(c1) AS m1, coalesce(var_samp(c0), 0) + 1 AS a, coalesce(covar_samp(c0, c1), 0) AS b, coalesce(var_samp(c1), 0) + 1 AS c FROM rim GROUP BY 1)
SELECT stem, y, x FROM m JOIN st USING (stem) WHERE sqrt(((c0 - m0) * (c0 - m0) * c - 2 * (c0 - m0) * (c1 - m1) * b + (c1 - m1) * (c1 - m1) * a) / (a * c - b * b)) > 1.75""")
def colour_seed(s, d):
    r = X.raster(s, d)
    r = r.withColumn("c0", F.transform("data", lambda v: F.floor(v * 180 / 256).cast("int"))).withColumn("c1", F.reverse("data"))
    r = r.withColumn("data", F.transform("data", lambda v: F.when(v > 100, 255).otherwise(0)))
    return _fg(G.colour_seed(r, ["c0", "c1"], "c1", color_thr=1.75))


@query(f"""WITH {X.PX}, a AS (SELECT round(avg(v) / 255, 6) AS f, round(avg(c1) / 4, 6) AS s FROM px)
SELECT f AS fraction, CASE WHEN f < 0.15 THEN 'global' WHEN f < 0.5 THEN 'coarse_grid' ELSE 'per_pixel' END AS model, s < 40 AS try_lab FROM a""")
def recommend_rules(s, d):
    px = X.pixels(s, d)
    row = lambda c, f: px.agg(F.lit(c).alias("channel"), F.round(f, 6).alias("spatial_fraction"), F.round(F.avg("c1") / 4, 6).alias("g_mean"))
    return D.recommend(row("c0", F.avg("v") / 255).unionByName(row("c1", F.avg("v") / 256)))


# --- models and flows ---------------------------------------------------------------------------------------------------------


@query(f"""WITH RECURSIVE {_OBJ}, inb AS (SELECT o.stem, obj_id, y, x, v FROM obj o JOIN px USING (stem) WHERE x >= round_even(x0, 0) AND x < round_even(x1, 0) AND y >= round_even(y0, 0) AND y < round_even(y1, 0)),
mean AS (SELECT stem, obj_id, avg(v) AS m FROM inb GROUP BY 1, 2), seg AS (SELECT stem, obj_id, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM inb JOIN mean USING (stem, obj_id) WHERE v > m GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY obj_id) - 1 AS INT) AS obj_id, CAST(x0 AS DOUBLE) AS x0, CAST(y0 AS DOUBLE) AS y0, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1 FROM seg""")
def segment_stub(s, d):
    from fieldloom.operators.model import BoxThreshold, segment

    return segment(X.raster(s, d), _objects(s, d)[1], BoxThreshold, min_area=2).select("stem", "obj_id", "x0", "y0", "x1", "y1")


def _frames(s, d):
    return X.raster(s, d).withColumnRenamed("data", "frame")


_STEP = {"op": "threshold_score", "inputs": {"dist": "frame"}}
_BOXES = "SELECT stem, min(x) AS x0, min(y) AS y0, max(x) + 1 AS x1, max(y) + 1 AS y1 FROM fg"


@query(f"WITH {X.PX}, {X.FG} {_BOXES} GROUP BY 1")
def flow_slots_shared(s, d):
    """The flow's shared threshold wins over the step's own; the mask goes by another name between the steps."""
    from .flow import Flow, run_flow

    flow = Flow(shared={"k": 160}, processes=[_STEP | {"k": 10, "slots": {"mask": "bright"}}, {"op": "mask_box", "inputs": {"mask": "bright"}, "outputs": {"bbox": {"level": "frame"}}}])
    return run_flow(flow, _frames(s, d)).tables["bbox"].select("stem", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


@query(f"WITH {X.PX}, {X.FG} {_BOXES} WHERE stem % 3 <> 0 GROUP BY 1")
def flow_working_items(s, d):
    from .flow import Flow, run_flow

    frames = _frames(s, d).withColumn("category", F.when(F.col("stem") % 3 == 0, "staged").otherwise("modified"))
    flow = Flow(processes=[_STEP | {"k": 160}, {"op": "mask_box", "outputs": {"bbox": {"level": "frame"}}}])
    return run_flow(flow, frames).tables["bbox"].select("stem", "bbox.x0", "bbox.y0", "bbox.x1", "bbox.y1")


@query(f"WITH RECURSIVE {_OBJ} SELECT stem, obj_id, CAST(count(*) AS BIGINT) AS area FROM obj JOIN px USING (stem) WHERE v > 160 AND x >= round_even(x0, 0) AND x < round_even(x1, 0) AND y >= round_even(y0, 0) AND y < round_even(y1, 0) GROUP BY 1, 2")
def flow_two_flows(s, d):
    """The first flow finds masks and objects, the second measures each object in the mask of its frame."""
    from .flow import Flow, run_flows

    find = Flow(name="find", processes=[_STEP | {"k": 160, "outputs": {"mask": {"level": "frame"}}}, {"op": "split_objects", "min_area": 2, "bbox_gap": 0.25, "outputs": {"object": {"level": "frame"}}}])
    each = Flow(name="each", unit="object", processes=[{"op": "box_area", "outputs": {"area": {}}}])
    results, _ = run_flows([find, each], _frames(s, d))
    return results[1].tables["area"].select("stem", F.col("obj_id").cast("int").alias("obj_id"), F.col("area").cast("long").alias("area"))


@query(f"""WITH {X.PX}, hist AS (SELECT 1 AS one, v AS bin, count(*) AS w FROM px GROUP BY ALL), {X.robust_sql('hist', 'one', 256, False)}
SELECT name, round(CASE name WHEN 'mean_c0' THEN mu ELSE sigma END, 6) AS value, second AS cached FROM stats, (SELECT unnest(['mean_c0', 'std_c0']) AS name) AS n, (SELECT true AS second) AS t""")
def flow_cache(s, d):
    """A cacheable flow is skipped the second time, as its params are there."""
    from .flow import Flow, run_flows

    spec = dict(processes=[{"op": "accumulate_histogram", "inputs": {"image": "frame"}}], carry=["acc"], finalize_processes=[{"op": "robust_stats", "outputs": {"mean_c0": {}, "std_c0": {}}}], cacheable=True)
    results, params = run_flows([Flow(**spec), Flow(**spec)], _frames(s, d))
    return results[0].params.select("name", rounded(F.col("value")).alias("value"), F.lit(results[1].cached and params["mean_c0"] is not None).alias("cached"))


@query(f"WITH {X.PX}, b AS (SELECT stem, y, x, CASE WHEN v > 160 THEN 255 ELSE 0 END AS v FROM px), {X.sweep_sql('b', 'c1_', 3, 'max')}, {X.sweep_sql('c1_', 'c2_', 3, 'min')} SELECT stem, y, x FROM c2_ WHERE v > 0")
def flow_close_edge(s, d):
    """The array kernel of a flow step against windows in SQL."""
    from .flow import Flow, run_flow

    flow = Flow(processes=[_STEP | {"k": 160}, {"op": "close_edge", "size": 3, "inputs": {"edge": "mask"}, "outputs": {"edge": {"level": "frame"}}}])
    return _fg(run_flow(flow, _frames(s, d)).tables["edge"].withColumnRenamed("edge", "data"))


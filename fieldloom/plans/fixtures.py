"""Rasters, masks, objects and catalogues derived from the driver's tables, in both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.functions.expressions import clip


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 x 8 frames ``(stem, label, h, w, data)``, one per embedding."""
    e = table(spark, sf_dir, "embeddings")
    data = F.transform("embedding", lambda v: clip(F.floor(128 + 256 * v.cast("double")), 0, 255).cast("int"))
    return e.select(F.col("vec_id").alias("stem"), "label", F.lit(8).alias("h"), F.lit(8).alias("w"), data.alias("data"))


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(stem, label, y, x, v, c0, c1)``: c0 is hue-like (180 bins), c1 the value of the pixel opposite."""
    px = raster(spark, sf_dir).select("stem", "label", F.posexplode("data").alias("i", "v"), "data")
    return px.select("stem", "label", F.expr("cast(i div 8 as int)").alias("y"), F.expr("cast(i % 8 as int)").alias("x"), "v", F.expr("cast(v * 180 div 256 as int)").alias("c0"), F.element_at("data", 64 - F.col("i")).alias("c1"))


def mask(spark: SparkSession, sf_dir: str, above: int = 160) -> DataFrame:
    """Array-form masks: 255 where the frame is above the value."""
    return raster(spark, sf_dir).withColumn("data", F.transform("data", lambda v: F.when(v > above, 255).otherwise(0)))


def foreground(spark: SparkSession, sf_dir: str, above: int = 160) -> DataFrame:
    return pixels(spark, sf_dir).where(F.col("v") > above).select("stem", "y", "x")


def other_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).where("(x + y + stem) % 3 = 0").select("stem", "y", "x")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misdetection fixture: every seventh vector is predicted as the next class."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.col("label").alias("gt"), ((F.col("label") + (F.col("vec_id") % 7 == 0).cast("int")) % 10).alias("pred"), F.col("embedding").alias("v"))


def catalog(spark: SparkSession, sf_dir: str, which: str = "all") -> DataFrame:
    """Catalogue rows of documents, with their lang and source as leaves.

    ``all`` holds every document. Merges need two catalogues that overlap in part: ``host`` has no French documents, ``other``
    every third one, with n_chars as well and its own states."""
    d = table(spark, sf_dir, "documents")
    step = 5 if which == "other" else 2
    own = {"all": d, "host": d.where("lang <> 'fr'"), "other": d.where("doc_id % 3 = 0")}[which]
    quoted = lambda n: F.struct(F.lit(n).alias("name"), F.concat(F.lit('"'), F.col(n), F.lit('"')).alias("value"))
    leaf = [quoted("lang"), quoted("source")] + ([F.struct(F.lit("n_chars").alias("name"), F.col("n_chars").cast("string").alias("value"))] if which == "other" else [])
    return own.select(
        F.when(F.col("doc_id") % step == 0, "staged").otherwise("modified").alias("category"), F.col("doc_id").cast("string").alias("stem"),
        F.array().cast("array<string>").alias("path"), F.explode(F.array(*leaf)).alias("l"),
    ).select("category", "stem", "path", "l.name", F.lit("attr").alias("type"), F.lit("str").alias("format"), "l.value")


#: The same in SQL.
PX = """px AS (
  SELECT stem, label, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, v, CAST(v * 180 // 256 AS INT) AS c0, data[64 - i] AS c1
  FROM (SELECT stem, label, data, i, data[i + 1] AS v FROM (
    SELECT vec_id AS stem, label, list_transform(embedding, lambda e: CAST(greatest(0, least(255, floor(128 + 256 * CAST(e AS DOUBLE)))) AS INT)) AS data
    FROM embeddings) AS r, (SELECT unnest(range(64)) AS i) AS g))"""
FG = "fg AS (SELECT stem, y, x FROM px WHERE v > 160)"
OTHER = "other AS (SELECT stem, y, x FROM px WHERE (x + y + stem) % 3 = 0)"
#: Components of a relation m(stem, y, x): label is the number of the first pixel in row order.
COMPONENTS = """reach AS (
  SELECT stem, y, x, y * 8 + x AS root FROM m
  UNION
  SELECT b.stem, b.y, b.x, a.root FROM reach AS a JOIN m AS b ON a.stem = b.stem AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1
), first_px AS (SELECT stem, y, x, min(root) AS root FROM reach GROUP BY ALL),
cc AS (SELECT stem, y, x, CAST(dense_rank() OVER (PARTITION BY stem ORDER BY root) AS INT) AS label FROM first_px)"""


def catalog_sql(which: str = "all") -> str:
    step = 5 if which == "other" else 2
    where = {"all": "true", "host": "lang <> 'fr'", "other": "doc_id % 3 = 0"}[which]
    own = f"SELECT CASE WHEN doc_id % {step} = 0 THEN 'staged' ELSE 'modified' END AS category, CAST(doc_id AS VARCHAR) AS stem"
    leaf = [f"{own}, '{n}' AS name, '\"' || {n} || '\"' AS value FROM documents WHERE {where}" for n in ("lang", "source")]
    if which == "other":
        leaf.append(f"{own}, 'n_chars', CAST(n_chars AS VARCHAR) FROM documents WHERE {where}")
    return f"{which if which != 'all' else 'refs'} AS ({' UNION ALL '.join(leaf)})"


def robust_sql(hist: str, by: str, bins: int, circular: bool) -> str:
    """CTEs that end in stats(by, mu, sigma), from hist(by, bin, w)."""
    at = f"((bin - mode + {bins // 2}) % {bins} + {bins}) % {bins} - {bins // 2}" if circular else "bin"
    mu = f"((mode + q50) % {bins} + {bins}) % {bins}" if circular else "q50"
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY w DESC, bin) AS rn FROM {hist}),
modes AS (SELECT {by}, bin AS mode FROM ranked WHERE rn = 1),
placed AS (SELECT {by}, mode, w, {at} AS place FROM {hist} JOIN modes USING ({by})),
cum AS (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY place) AS cw, sum(w) OVER (PARTITION BY {by}) AS total FROM placed),
quart AS (SELECT {by}, min(mode) AS mode, min(CASE WHEN cw >= total * 0.5 THEN place END) AS q50, min(CASE WHEN cw >= total * 0.25 THEN place END) AS q25,
  min(CASE WHEN cw >= total * 0.75 THEN place END) AS q75 FROM cum GROUP BY {by}),
stats AS (SELECT {by}, CAST({mu} AS DOUBLE) AS mu, (q75 - q25) / 1.349 AS sigma FROM quart)"""


def sweep_sql(src: str, out: str, size: int, op: str) -> str:
    """Two CTEs: the extreme of v over a rectangle."""
    back, ahead = size // 2, size - 1 - size // 2
    return f"""{out}_r AS (SELECT stem, y, x, {op}(v) OVER (PARTITION BY stem, y ORDER BY x RANGE BETWEEN {back} PRECEDING AND {ahead} FOLLOWING) AS v FROM {src}),
{out} AS (SELECT stem, y, x, {op}(v) OVER (PARTITION BY stem, x ORDER BY y RANGE BETWEEN {back} PRECEDING AND {ahead} FOLLOWING) AS v FROM {out}_r)"""

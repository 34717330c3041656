"""Registered queries over neighbours, layouts and clusters of vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from fieldloom.functions.expressions import rounded
from fieldloom.operators import clusters as C
from fieldloom.operators import layout as L
from fieldloom.operators import neighbours as N
from fieldloom.sources.scratch import Scratch

from . import fixtures as X
from .queries import query


def _vectors(s, d):
    return X.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query("""WITH e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
p AS (SELECT a.id, b.id AS near, list_distance(a.v, b.v) AS d, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS rank FROM e a JOIN e b ON a.id <> b.id QUALIFY rank <= 15)
SELECT id, rank, near, round(d, 6) AS d FROM p""")
def embedding_neighbours(s, d):
    """The 15 nearest other vectors of each, exactly."""
    scratch = Scratch(s, "neighbours")
    points = N.numbered_points(_vectors(s, d), scratch)
    found = N.neighbours(N.dealt(points, scratch), 15, scratch)
    ids = points[0].select("p", "id")
    found = found.join(ids, "p").join(ids.select(F.col("p").alias("q"), F.col("id").alias("near")), "q")
    return found.select("id", F.row_number().over(Window.partitionBy("id").orderBy("d", "near")).cast("long").alias("rank"), "near", rounded(F.col("d"), 6).alias("d"))


@query()
def embedding_clusters(s, d):
    """Density clusters of the vectors themselves."""
    return C.hdbscan(_vectors(s, d), min_samples=2)


@query()
def embedding_layout_clusters(s, d):
    """Z-scores, layout in two dimensions, and its density clusters."""
    found = L.embedded(_vectors(s, d))
    return found.select("id", rounded(F.col("y")[0], 4).alias("x"), rounded(F.col("y")[1], 4).alias("y"), "cluster")

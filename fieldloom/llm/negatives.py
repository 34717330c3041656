"""Hard-negative mining by ball trees with branch and bound.

Vectors become whole numbers, ``floor(256 * x)``, and a score is an inner product of those, so results are exact. Rows are dealt
into blocks of ``BLOCK`` by label (a label of any share spans many blocks), anchors into chunks of about ``CHUNK``. One task
takes a block and a chunk: it builds a ball tree over the block and walks it once for all anchors of the chunk, each
anchor with a window of scores. ``q . c + |q| r`` bounds the scores in a ball from above and ``q . c - |q| r`` from below:
a ball goes where that range misses the window, where its best is strictly beneath the anchor's k-th score so far (an equal
one may win by its id), or where its labels don't fit. Each block's first ``k`` are merged by a window.

First the positives are searched, in the blocks that hold the anchor's label; their scores set the windows of the second search.

* Rows with a null id, label or vector, or with a null or non-finite component take no part.
* Only vectors of equal length meet. Components are cut at ``(2^62 / length) ^ 0.5``, so that every score fits a long.
* Repeated rows are rows of their own: an anchor's twin is another row, and each of two equal anchors has its own result rows.
* An empty table, an anchor alone in its label, or a window without rows give no rows. Only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .ranges import numbered

BLOCK, CHUNK, LEAF = 8_192, 4_096, 48
SCALE, LEAST, MOST = 256, -(2**63), 2**63 - 1


class BallTree:
    """Balls over rows of whole numbers; children of a node halve its rows along the line between two far ones."""

    def __init__(self, x: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> None:
        points = x.astype(np.float64)
        order, self.nodes, todo = np.arange(len(x)), [], [(0, len(x), -1, 0)]
        while todo:
            a, b, parent, side = todo.pop()
            rows = points[order[a:b]]
            center = rows.mean(axis=0)
            away = ((rows - center) ** 2).sum(axis=1)
            own = labels[order[a:b]]
            if parent >= 0:
                self.nodes[parent][5 + side] = len(self.nodes)
            self.nodes.append([a, b, center, np.sqrt(away.max()) * (1 + 1e-9), (own.min(), own.max()), -1, -1])
            if b - a > leaf:
                one = rows[away.argmax()]
                other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
                half = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(rows @ (other - one), half)]
                todo += [(a, a + half, len(self.nodes) - 1, 0), (a + half, b, len(self.nodes) - 1, 1)]
        self.order = order


class Best:
    """The first k of each query: higher scores, then smaller ids."""

    def __init__(self, queries: int, k: int) -> None:
        self.k, self.n = k, np.zeros(queries, np.int64)
        self.score, self.id, self.kth = np.full((queries, k), LEAST), np.full((queries, k), MOST), np.full(queries, LEAST)

    def add(self, query: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        hit = np.unique(query)
        held = np.arange(self.k)[None, :] < self.n[hit][:, None]
        q = np.concatenate([query, np.repeat(hit, held.sum(axis=1))])
        s, i = np.concatenate([score, self.score[hit][held]]), np.concatenate([row_id, self.id[hit][held]])
        o = np.lexsort((i, -s, q))
        q, s, i = q[o], s[o], i[o]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        o = place < self.k
        self.score[q[o], place[o]], self.id[q[o], place[o]] = s[o], i[o]
        self.n[hit] = np.minimum(np.searchsorted(q, hit, "right") - np.searchsorted(q, hit), self.k)
        full = hit[self.n[hit] == self.k]
        self.kth[full] = self.score[full, -1]


def search(x: np.ndarray, ids: np.ndarray, places: np.ndarray, labels: np.ndarray, queries: np.ndarray, of: np.ndarray, own: np.ndarray, wanted: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int, seen: list | None = None) -> Best:
    """Branch and bound for windows ``low <= score <= high``; window w asks for query ``of[w]`` (ascending).

    ``own`` and ``wanted`` are place and label of each query: rows of that label are searched if ``same``, else all others, and never
    the query itself. ``seen`` gets the number of (window, row) pairs that were scored.
    """
    tree, best = BallTree(x, labels), Best(len(of), k)
    top = max(1, int(abs(x).max(initial=0))) * max(1, int(abs(queries).max(initial=0))) * max(1, x.shape[1])
    kind = np.float64 if top < 2**53 else np.int64  # products of doubles are exact below
    rows, asked, asked_f = x[tree.order].astype(kind), queries.astype(kind), queries.astype(np.float64)
    ids, places, labels, norm = ids[tree.order], places[tree.order], labels[tree.order], np.sqrt((asked_f**2).sum(axis=1))
    todo = [(0, np.arange(len(of)))]
    while todo:
        at, live = todo.pop()
        a, b, center, radius, (least, most), left, right = tree.nodes[at]
        label = wanted[of[live]]
        fits = (label >= least) & (label <= most) if same else ~((label == least) & (label == most))
        mid = asked_f @ center
        mid, span = mid[of[live]], norm[of[live]] * radius
        span = span + 1e-9 * (abs(mid) + span) + 1e-3
        live = live[fits & (mid + span >= np.maximum(low[live], best.kth[live])) & (mid - span <= high[live])]
        if not len(live):
            continue
        if left >= 0:
            closer = asked_f[of[live]].sum(axis=0)
            pair = sorted((left, right), key=lambda c: float(closer @ tree.nodes[c][2]))
            todo += [(c, live) for c in pair]  # the one with higher scores is next
            continue
        who, back = np.unique(of[live], return_inverse=True)
        score = (asked[who] @ rows[a:b].T).astype(np.int64)[back]
        if seen is not None:
            seen.append(score.size)
        meets = (labels[None, a:b] == wanted[of[live]][:, None]) == same
        ok = meets & (places[None, a:b] != own[of[live]][:, None]) & (score >= np.maximum(low[live], best.kth[live])[:, None]) & (score <= high[live][:, None])
        w, r = np.nonzero(ok)
        if len(w):
            best.add(live[w], score[w, r], ids[a:b][r])
    return best


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    flat = flat.flatten() if not isinstance(flat, pa.ChunkedArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])
    return np.asarray(flat, dtype=np.int64).reshape(table.num_rows, -1) if len(flat) else np.zeros((table.num_rows, 0), np.int64)


def _searched(rows: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """``(dim, anchor, j, row_id, score)``: the first k of each block for each anchor and window ``j``, merged.

    ``asked(dim, block, chunk, anchor, label, v, low array, high array)``; ``rows(dim, block, chunk, idx, vec_id, label, v)``.
    """
    names = ["dim", "anchor", "j", "row_id", "score"]
    schema = pa.schema([("dim", pa.int32()), ("anchor", pa.int64()), ("j", pa.int32()), ("row_id", pa.int64()), ("score", pa.int64())])

    def kernel(block: pa.Table, chunk: pa.Table) -> pa.Table:
        if not block.num_rows or not chunk.num_rows:
            return schema.empty_table()
        chunk = chunk.rename_columns([c.removeprefix("q_") for c in chunk.column_names])
        take = lambda t, c: t.column(c).to_numpy().astype(np.int64)
        low, high = chunk.column("low").to_pylist(), chunk.column("high").to_pylist()
        of = np.repeat(np.arange(len(low)), [len(w) for w in low])
        j = np.concatenate([np.arange(len(w)) for w in low])
        anchors = take(chunk, "anchor")
        best = search(_matrix(block), take(block, "vec_id"), take(block, "idx"), take(block, "label"), _matrix(chunk), of, anchors, take(chunk, "label"), np.array([v for w in low for v in w], np.int64), np.array([v for w in high for v in w], np.int64), same, k)
        w, p = np.nonzero(np.arange(k)[None, :] < best.n[:, None])
        return pa.table([np.full(len(w), chunk.column("dim")[0].as_py(), np.int32), anchors[of[w]], j[w].astype(np.int32), best.id[w, p], best.score[w, p]], schema=schema)

    on = ("dim", "block", "chunk")
    renamed = asked.select(*[F.col(c).alias(f"q_{c}") for c in asked.columns])  # both sides stem from one table
    found = rows.groupBy(*on).cogroup(renamed.groupBy(*[f"q_{c}" for c in on])).applyInArrow(kernel, "dim int, anchor long, j int, row_id long, score long")
    place = F.row_number().over(Window.partitionBy("dim", "anchor", "j").orderBy(F.desc("score"), "row_id"))
    return found.withColumn("place", place).where(F.col("place") <= k).select(*names, "place")


def whole_numbers(v: Column) -> Column:
    """``floor(256 * x)`` of each component, cut so that inner products fit a long."""
    edge = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(v), F.lit(1)))).cast("double")
    return F.transform(v, lambda x: F.floor(F.least(F.greatest(x.cast("double") * SCALE, -edge), edge)).cast("long"))


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None, positives: int = 5, negatives: int = 5, least: int = 80, most: int = 100, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Negatives are the first rows of another label with ``least * p <= 100 * n <= most * p`` for the positive's score p. ``is_anchor`` and
    ``label`` are expressions over the columns of ``vectors``.
    """
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    label = F.col(label_col) if label is None else label
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), whole_numbers(v).alias("v"), F.size(v).alias("dim"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = numbered(rows.withColumn("mixed", F.xxhash64("vec_id")), "dim", ["label", "mixed"])
    rows = stored(rows.select("dim", "idx", F.expr(f"idx div {BLOCK}").alias("block"), "vec_id", "label", "v", "asks"), "mine-rows")
    # one row for each length of vectors
    counts = stored(rows.groupBy("dim").agg((F.max("block") + 1).alias("blocks"), F.greatest(F.lit(1), F.ceil(F.sum(F.col("asks").cast("int")) / CHUNK)).alias("chunks")), "mine-counts")
    own = F.pmod(F.xxhash64("idx"), F.col("chunks")).alias("chunk")
    anchors = rows.where("asks").join(counts, "dim").select("dim", own, F.col("idx").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v", "blocks")
    each = rows.join(counts.select("dim", "chunks"), "dim").select("dim", "block", "idx", "vec_id", "label", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    fields = ("dim", "block", "chunk", "anchor", "label", "v", "low", "high")
    holds = rows.select("dim", "label", "block").distinct()
    first = anchors.join(holds, ["dim", "label"]).withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST))})
    near = _searched(each, first.select(*fields), True, positives)
    near = stored(near.select("dim", "anchor", (F.col("place") - 1).alias("j"), F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "mine-positives")
    # p below zero has no window: 0.8 p is above p
    ordered = near.groupBy("dim", "anchor").agg(F.transform(F.sort_array(F.collect_list(F.struct("j", "positive_score"))), lambda s: s["positive_score"]).alias("p"))
    windows = {"low": F.transform("p", lambda s: F.ceil(s * (F.lit(least).cast("decimal(20,0)")) / 100).cast("long")), "high": F.transform("p", lambda s: F.floor(s * (F.lit(most).cast("decimal(20,0)")) / 100).cast("long"))}
    second = anchors.join(ordered, ["dim", "anchor"]).withColumns(windows).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    far = _searched(each, second.select(*fields), False, negatives)
    out = far.join(near, ["dim", "anchor", "j"]).join(anchors.select("dim", "anchor", "anchor_id"), ["dim", "anchor"])
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), F.col("row_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def shifted_label() -> Column:
    """The label, moved on by one (modulo 10) where 7 divides the id."""
    return F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))


def oracle_sql() -> str:
    return """WITH e AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
 FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS ar, a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score FROM e a JOIN e ON a.r <> e.r AND len(a.v) = len(e.v) WHERE a.vec_id % 100 = 0),
p AS (SELECT ar, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, id) AS j FROM s WHERE same QUALIFY j <= 5),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, j ORDER BY s.score DESC, s.id) AS rank FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * positive_score <= 100 * s.score AND 100 * s.score <= 100 * positive_score QUALIFY rank <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM n"""

"""ANA-EMBED, layout: a neighbour graph drawn in few dimensions (UMAP) as Spark jobs.

1. Neighbours exactly, by ``neighbours``, of up to ``EXACT`` points, where that is quicker than rounds; by descent beyond: two dealings into blocks by different pivots give first lists; then points that are neighbours of one
   point, in either direction, are tried as neighbours of each other, until a round changes under ``SETTLED`` of all places.
2. Fuzzy weights: ``exp(-(d - nearest) / sigma)``, sigma so that a point's weights sum to ``log2(k)``, joined from both sides as ``a + b - a b``.
3. Layout by negative sampling, in outer rounds: points are dealt into blocks of neighbours, and a task moves the points of
   its block through some epochs. Ends in other blocks and a bounded sample of all points, for the pushes, stay
   where the round before left them. Positions start at the first principal components.

A task holds a block with its edges, or a point's sampled neighbours; no table passes through one task or the driver. Random numbers
come from the seed, the point and the block, so runs agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.sources.scratch import Scratch

from . import neighbours as N

SETTLED, TRIED, DEALINGS, PUSHED, BATCHES = 0.002, 12, 2, 2_000, 8
EXACT = 200_000


def descend(points: tuple[DataFrame, int, int], k: int, scratch: Scratch, seed: int = 0, rounds: int = 12) -> DataFrame:
    """``(p, q, d)``: about the k nearest other points of each of ``points`` (``neighbours.numbered_points``)."""
    rows, n, _ = points
    vectors = rows.select("p", "v")
    found = None
    for i in range(DEALINGS):
        own = N.neighbours(N.dealt(points, scratch, seed + i), k, scratch, exact=False)
        found = own if found is None else found.union(own)
    place = lambda c, *by: F.row_number().over(Window.partitionBy(c).orderBy(*by))
    graph = scratch.kept(found.distinct().withColumn("place", place("p", "d", "q")).where(F.col("place") <= k).select("p", "q", "d", F.lit(True).alias("fresh")))
    if n <= N.BLOCK:  # one block has had all pairs
        return graph.select("p", "q", "d")

    def pairs(t: pa.Table) -> pa.Table:
        ids, v = t.column("q").to_numpy(), N.matrix(t.column("v"))
        far, fresh = t.column("far").to_numpy(), t.column("fresh").to_numpy(zero_copy_only=False)
        i, j = np.nonzero((ids[:, None] < ids[None, :]) & (fresh[:, None] | fresh[None, :]))
        d = np.sqrt(((v[i] - v[j]) ** 2).sum(axis=1))
        a, b = d < far[i], d < far[j]
        return pa.table([np.concatenate([ids[i][a], ids[j][b]]), np.concatenate([ids[j][a], ids[i][b]]), np.concatenate([d[a], d[b]])], names=["p", "q", "d"])

    for r in range(rounds):
        # each point's sampled neighbours, in either direction, with their vectors and worst places
        ends = graph.select("p", "q", "fresh").union(graph.select(F.col("q").alias("p"), F.col("p").alias("q"), "fresh"))
        ends = ends.groupBy("p", "q").agg(F.max("fresh").alias("fresh")).withColumn("place", place("p", F.desc("fresh"), F.xxhash64("q", "p", F.lit(seed + r)))).where(F.col("place") <= 2 * TRIED)
        # a list that isn't full takes anything
        far = graph.groupBy("p").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("far"))
        known = vectors.join(far, "p", "left").select(F.col("p").alias("q"), "v", F.coalesce("far", F.lit(float("inf"))).alias("far"))
        tried = ends.select("p", "q", "fresh").join(known, "q").groupBy("p").applyInArrow(pairs, "p long, q long, d double")
        both = graph.select("p", "q", "d", F.lit(False).alias("fresh")).union(tried.distinct().withColumn("fresh", F.lit(True)))
        both = both.groupBy("p", "q").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
        graph = scratch.kept(both.withColumn("place", place("p", "d", "q")).where(F.col("place") <= k).select("p", "q", "d", "fresh"))
        if graph.where("fresh").count() <= SETTLED * n * k:
            break
    return graph.select("p", "q", "d")


def fuzzy(graph: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """``(p, q, w)`` in both directions."""

    def weigh(batches):
        for batch in batches:
            lists = batch.column(1).to_pylist()
            width = max(map(len, lists), default=0)
            d = np.full((len(lists), width), np.inf)
            for i, own in enumerate(lists):
                d[i, : len(own)] = [x["d"] for x in own]
            nearest = np.where(d > 0, d, np.inf).min(axis=1, initial=np.inf)
            nearest[~np.isfinite(nearest)] = 0.0
            over = np.maximum(d - nearest[:, None], 0)
            low, high = np.zeros(len(lists)), np.full(len(lists), np.inf)
            sigma, goal = np.ones(len(lists)), np.log2(max(2, k))
            for _ in range(64):
                more = np.exp(-over / sigma[:, None]).sum(axis=1) > goal
                high, low = np.where(more, sigma, high), np.where(more, low, sigma)
                sigma = np.where(np.isfinite(high), (low + high) / 2, sigma * 2)
            mean = np.array([np.mean(x[np.isfinite(x)]) if np.isfinite(x).any() else 0.0 for x in d])
            sigma = np.maximum(sigma, 1e-3 * mean + 1e-12)
            w = np.exp(-over / sigma[:, None])
            ps = batch.column(0).to_numpy()
            rows = [(p, x["q"], w[i, j]) for i, p in enumerate(ps) for j, x in enumerate(lists[i])]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["p", "q", "w"])

    lists = graph.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("d", "q"))).alias("n"))  # k at most
    one = lists.mapInArrow(weigh, "p long, q long, w double")
    both = one.union(one.select(F.col("q").alias("p"), F.col("p").alias("q"), "w")).groupBy("p", "q").agg((F.sum("w") - F.when(F.count("*") > 1, F.product("w")).otherwise(0.0)).alias("w"))
    return scratch.kept(both)


def curve(min_dist: float, spread: float = 1.0) -> tuple[float, float]:
    """a and b of ``1 / (1 + a x^2b)``, the least squares fit to 1 up to ``min_dist`` and an exponential decay beyond."""
    x = np.linspace(0, spread * 3, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    p = np.array([1.0, 1.0])
    for _ in range(200):
        t = x ** (2 * p[1])
        f = 1 / (1 + p[0] * t)
        slope = np.stack([-t * f * f, -p[0] * t * 2 * np.log(x) * f * f], axis=1)
        p = np.maximum(p + 0.5 * np.linalg.lstsq(slope, y - f, rcond=None)[0], 1e-3)
    return float(p[0]), float(p[1])


def moved(own: np.ndarray, y: np.ndarray, p: np.ndarray, q: np.ndarray, w: np.ndarray, at: np.ndarray, pushed: np.ndarray, ab: tuple[float, float], steps: np.ndarray, rng: np.random.Generator, pushes: int = 5) -> np.ndarray:
    """Positions of a block after an epoch for each learning rate in ``steps``; ``at`` are the positions of ``q``, used where it isn't of the block."""
    a, b = ab
    i, j = np.searchsorted(own, p), np.searchsorted(own, q)
    inner = (j < len(own)) & (own[np.minimum(j, len(own) - 1)] == q)
    y, share = y.copy(), w / max(w.max(initial=0), 1e-12)
    for step in steps:
        picked = np.nonzero(rng.random(len(p)) < share)[0]
        rng.shuffle(picked)
        for e in np.array_split(picked, BATCHES):
            if not len(e):
                continue
            end = np.where(inner[e][:, None], y[np.minimum(j[e], len(own) - 1)], at[e])
            gap = y[i[e]] - end
            r = (gap * gap).sum(axis=1, keepdims=True)
            pull = np.where(r > 0, -2 * a * b * np.maximum(r, 1e-12) ** (b - 1) / (1 + a * r**b), 0.0)
            turn = np.zeros_like(y)
            np.add.at(turn, i[e], np.clip(pull * gap, -4, 4))
            who = np.repeat(i[e], pushes)
            near = rng.random(len(who)) < len(own) / (len(own) + len(pushed))
            other = np.where(near[:, None], y[rng.integers(0, len(own), len(who))], pushed[rng.integers(0, len(pushed), len(who))])
            gap = y[who] - other
            r = (gap * gap).sum(axis=1, keepdims=True)
            push = np.where(r > 0, 2 * b / ((0.001 + r) * (1 + a * r**b)), 0.0)
            np.add.at(turn, who, np.clip(push * gap, -4, 4))
            y += step * turn
    return y


def _mover(pushed: np.ndarray, ab: tuple[float, float], steps: np.ndarray, seed: tuple[int, int]):
    take = lambda t, c: t.column(c).to_numpy()

    def move(own: pa.Table, ends: pa.Table) -> pa.Table:
        own, ends = own.sort_by("p"), ends.sort_by([("e_p", "ascending"), ("q", "ascending")])
        y = N.matrix(own.column("y"))
        if ends.num_rows:
            rng = np.random.default_rng([*seed, int(own.column("block")[0].as_py())])
            y = moved(take(own, "p"), y, take(ends, "e_p"), take(ends, "q"), take(ends, "w"), N.matrix(ends.column("e_y")), pushed, ab, steps, rng)
        return pa.table([own.column("p"), N.vectors_of(y)], names=["p", "y"])

    return move


def principal(points: tuple[DataFrame, int, int], parts: int) -> DataFrame:
    """``(p, y)``: coordinates along the directions of largest variance; sums of products are gathered per task, so only a square of the components reaches the driver."""
    rows, n, length = points

    def sums(batches):
        total, square = np.zeros(length), np.zeros((length, length))
        for batch in batches:
            v = N.matrix(pa.chunked_array([batch.column(0)]))
            total, square = total + v.sum(axis=0), square + v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total, square.ravel()]).tolist()])], names=["s"])

    parted = rows.select("v").mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"))
    s = np.array([r.x for r in parted.orderBy("i").collect()])
    mean = s[:length] / n
    value, vector = np.linalg.eigh(s[length:].reshape(length, length) / n - np.outer(mean, mean))
    axes = vector[:, ::-1][:, :parts]
    axes = axes * np.sign(axes[abs(axes).argmax(axis=0), np.arange(axes.shape[1])])
    if axes.shape[1] < parts:
        axes = np.pad(axes, ((0, 0), (0, parts - axes.shape[1])))
    scale = 10 / max(float(np.sqrt(max(value[-1], 0))) * 3, 1e-12)

    def turn(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), N.vectors_of((N.matrix(pa.chunked_array([batch.column(1)])) - mean) @ axes * scale)], names=["p", "y"])

    return rows.select("p", "v").mapInArrow(turn, "p long, y array<double>")


def umap(vectors: DataFrame, n_components: int = 2, n_neighbors: int = 15, min_dist: float = 0.1, random_state: int = 42, epochs: int = 300, outer: int = 50, scaled: bool = True) -> DataFrame:
    """``(id, y array<double>)`` of each row of ``(id, v array)``; see ``neighbours.numbered_points`` for rows that don't count.

    Components are standardised first, as z-scores, if ``scaled``. Up to two rows stay at their principal coordinates.
    """
    scratch = Scratch(vectors.sparkSession, "layout")
    rows, n, length = points = N.numbered_points(vectors, scratch)
    if scaled and n:
        stats = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).orderBy("i").collect()  # a row for each component
        mean, dev = F.array(*[F.lit(r.m) for r in stats]), F.array(*[F.lit(r.s if r.s and r.s > 1e-12 else 1.0) for r in stats])
        rows = scratch.kept(rows.withColumn("v", F.transform("v", lambda x, i: (x - F.get(mean, i)) / F.get(dev, i))))
        points = (rows, n, length)
    if n == 0:
        return rows.select("id", F.array().cast("array<double>").alias("y"))
    y = scratch.kept(principal(points, n_components))
    ids = rows.select("p", "id")
    if n <= 2:
        return ids.join(y, "p").select("id", "y")
    k = min(n_neighbors, n - 1)
    blocks = N.dealt(points, scratch, random_state)
    graph = N.neighbours(blocks, k, scratch) if n <= EXACT else descend(points, k, scratch, random_state)
    edges = fuzzy(graph, k, scratch)
    block = blocks.points.select("p", "block")
    edges = scratch.kept(edges.join(block, "p"))
    outer = outer if len(blocks.block) > 1 else 1  # nothing is held still in a single block
    ab, rates = curve(min_dist), 1 - np.arange(epochs) / epochs
    for r in range(outer):
        steps = rates[r * epochs // outer : (r + 1) * epochs // outer]
        pushed = np.array([x.y for x in y.orderBy(F.xxhash64("p", F.lit(r)), "p").limit(PUSHED).collect()])
        own = y.join(block, "p")
        ends = edges.select(F.col("p").alias("e_p"), "q", "w", F.col("block").alias("e_block")).join(y.select(F.col("p").alias("q"), F.col("y").alias("e_y")), "q")
        y = scratch.kept(own.groupBy("block").cogroup(ends.groupBy("e_block")).applyInArrow(_mover(pushed, ab, steps, (random_state, r)), "p long, y array<double>"))
    return ids.join(y, "p").select("id", "y")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: share of the exact neighbours ``(p, q)`` that were found."""
    return exact.select("p", "q").join(found.select("p", "q", F.lit(1).alias("hit")), ["p", "q"], "left").agg((F.count("hit") / F.count("*")).alias("recall"))


def embedded(vectors: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None, **layout) -> DataFrame:
    """ANA-EMBED: ``(id, y, cluster)``: z-scores, layout, and the density clusters of the layout, -1 for noise."""
    from .clusters import hdbscan

    y = Scratch(vectors.sparkSession, "embedded").kept(umap(vectors, **layout))
    return y.join(hdbscan(y.withColumnRenamed("y", "v"), min_cluster_size, min_samples), "id")

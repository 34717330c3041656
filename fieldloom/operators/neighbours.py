"""Exact nearest-neighbour and nearest-stranger searches over vectors, in blocks that Spark deals.

Points are dealt into blocks by the nearest of at most ``PIVOTS`` sampled ones (a crowded pivot is split). Of every block
only a ball is known everywhere: its pivot, radius, and what else prunes. A point is searched in its own block first, which
bounds what it still looks for; then it is sent to those blocks only whose ball that bound reaches. Blocks are sent to in groups, so a
point travels once for each group with such a block, and groups grow with the table. Distances are measured
from differences, so both ends of a pair see the same number; products only tell which pairs to measure.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.scratch import Scratch

from .ranges import numbered

#: Pivots, and so the balls that are known everywhere, never exceed this; blocks grow beyond ``PIVOTS * BLOCK`` points.
PIVOTS, BLOCK, CELLS = 4096, 2048, 1 << 18
#: Points of a group and of those that ask in it: an eighth of the table, so that tasks are many, up to this, so that a task's memory is bounded.
SIDE = 32_768


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays([c.flatten() for c in column.chunks]) if column.num_chunks else pa.array([], pa.float64())
    return np.asarray(flat, dtype=np.float64).reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0))


def vectors_of(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1] or 1, dtype=np.int32), m.ravel()) if m.size else pa.array([[]] * len(m), pa.list_(pa.float64()))


def _gaps(q: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, float]:
    """Squared distances by products, and by how much they may be off."""
    a, b = (q * q).sum(axis=1), (x * x).sum(axis=1)
    return a[:, None] + b[None, :] - 2 * (q @ x.T), 1e-9 * float(a.max(initial=0) + b.max(initial=0)) + 1e-300


def _sliced(n: int, m: int) -> Iterator[slice]:
    step = max(1, CELLS // max(1, m))
    return (slice(a, a + step) for a in range(0, n, step))


def _quick_gaps(q: np.ndarray, x: np.ndarray, within: float) -> tuple[np.ndarray, float]:
    """The same in single precision around the middle of ``x``, where that is exact enough to tell what is ``within`` a squared distance."""
    if q.shape[1] >= 16 and len(q) and np.isfinite(within):
        middle = x.mean(axis=0)
        a, b = q - middle, x - middle
        aa, bb = (a * a).sum(axis=1), (b * b).sum(axis=1)
        scale = (np.sqrt(aa.max()) + np.sqrt(bb.max())) ** 2
        slack = (q.shape[1] + 16) * 2.0**-22 * scale  # over four times the rounding of a sum of that many products
        if 1e-20 < scale < 1e20 and slack <= 0.05 * within:
            left = np.concatenate([-2 * a, aa[:, None], np.ones((len(a), 1))], axis=1).astype(np.float32)
            right = np.concatenate([b, np.ones((len(b), 1)), bb[:, None]], axis=1).astype(np.float32)
            return left @ right.T, slack
    return _gaps(q, x)


class Lists:
    """The k nearest so far, within ``most``, of each point of ``q``, itself left out: nearest first, then by id."""

    def __init__(self, q: np.ndarray, own: np.ndarray, k: int, most: np.ndarray) -> None:
        self.q, self.own, self.k, self.most = q, own, k, np.array(most, dtype=np.float64)
        self.d, self.ids = np.full((len(q), k), np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
        self.held, self.count = [], 0

    def offer(self, rows: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        open_ = ~np.isfinite(self.most[rows])
        for part in (rows[open_], rows[~open_]):
            for s in _sliced(len(part), len(x)):
                at = part[s]
                bound = self.most[at] ** 2
                gap, slack = _quick_gaps(self.q[at], x, float(np.median(bound)))
                if len(x) > self.k and not np.isfinite(bound).all():  # one more than k, for the point itself may be among them
                    bound = np.minimum(bound, np.partition(gap, self.k, axis=1)[:, self.k] + slack)
                r, c = np.nonzero(gap <= (bound * (1 + 1e-12) + slack)[:, None])
                r = at[r]
                other = ids[c] != self.own[r]
                r, c = r[other], c[other]
                d = np.sqrt(((self.q[r] - x[c]) ** 2).sum(axis=1))
                near = d <= self.most[r]
                self.held.append((r[near], ids[c[near]], d[near]))
                self.count += int(near.sum())
            if self.count > 8 * len(self.q) or open_.any():
                self.settle()

    def settle(self) -> None:
        if not self.count:
            return
        r, ids, d = (np.concatenate(v) for v in zip(*self.held))
        self.held, self.count = [], 0
        who, r = np.unique(r, return_inverse=True)
        r, ids, d = np.concatenate([np.repeat(np.arange(len(who)), self.k), r]), np.concatenate([self.ids[who].ravel(), ids]), np.concatenate([self.d[who].ravel(), d])
        o = np.lexsort((ids, d, r))
        r, ids, d = r[o], ids[o], d[o]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        first = place < self.k
        self.ids[who[r[first]], place[first]], self.d[who[r[first]], place[first]] = ids[first], d[first]
        self.most[who] = np.minimum(self.most[who], self.d[who, -1])

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, ids and distances."""
        self.settle()
        r, c = np.nonzero(np.isfinite(self.d))
        return r, self.ids[r, c], self.d[r, c]


def strangers(q: pa.Table, x: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``q``, ids and weights: for each, the row of ``x`` of another component by least weight, then by ends.

    The weight is the mutual reachability: the largest of both cores and the distance. ``most`` bounds what a row looks for.
    """
    take = lambda t, c: t.column(c).to_numpy()
    a, b, ids, own = matrix(q.column("v")), matrix(x.column("v")), take(x, "p"), take(q, "p")
    core, far, comp, other, most = take(q, "core"), take(x, "core"), take(q, "comp"), take(x, "comp"), take(q, "most")
    out = []
    for s in _sliced(len(a), len(b)):
        gap, slack = _gaps(a[s], b)
        reach = np.maximum(np.maximum(np.sqrt(np.maximum(gap, 0)), core[s][:, None]), far[None, :])
        reach[comp[s][:, None] == other[None, :]] = np.inf
        # candidates: all that may be the least, within what the products are off by
        least = np.minimum(reach.min(axis=1, initial=np.inf), most[s])
        off = np.sqrt(slack)
        r, c = np.nonzero((reach <= (least + 2 * off)[:, None]) & np.isfinite(reach))
        w = np.maximum(np.maximum(np.sqrt(((a[s][r] - b[c]) ** 2).sum(axis=1)), core[s][r]), far[c])
        p, t = own[s][r], ids[c]
        o = np.lexsort((np.maximum(p, t), np.minimum(p, t), w, r))
        r, c, w = r[o], c[o], w[o]
        first = np.arange(len(r)) == np.searchsorted(r, r)
        out.append((r[first] + s.start, c[first], w[first]))
    return tuple(np.concatenate(v) for v in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))


@dataclass
class Balls:
    """``block``, ``center``, ``radius`` and ``group`` of each block, by block."""

    block: np.ndarray
    center: np.ndarray
    radius: np.ndarray
    group: np.ndarray

    def reached(self, q: np.ndarray, most: np.ndarray, block: int) -> np.ndarray:
        """Which of ``q`` a block's ball may have something for."""
        i = int(np.searchsorted(self.block, block))
        gap, slack = _gaps(q, self.center[i : i + 1])
        return np.nonzero(np.sqrt(np.maximum(gap[:, 0], 0)) - self.radius[i] - np.sqrt(slack) <= most)[0]


@dataclass
class Blocks:
    """``points(p, id, block, grp, v)`` and the balls of their blocks; a group has about ``side`` points."""

    points: DataFrame
    balls: Balls
    side: int
    n: int

    @property
    def block(self) -> np.ndarray:
        return self.balls.block


def numbered_points(vectors: DataFrame, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """``(p, id, v array<double>)`` of ``(id, v)``, numbered from 0 by id and vector, with the number of rows and of components.

    Rows with a null id or vector or with a component that is null or not finite are left out, as are those of another length than the most frequent one
    (the longest of such).
    """
    sound = vectors.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = scratch.kept(sound.select("id", F.transform("v", lambda x: x.cast("double")).alias("v")))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    length = length.d if length else 0
    rows = numbered(rows.where(F.size("v") == length).withColumn("all", F.lit("")), "all", ["id", "v"], scratch=scratch)
    rows = scratch.kept(rows.select(F.col("idx").alias("p"), "id", "v"))
    return rows, rows.count(), length


def dealt(points: tuple[DataFrame, int, int], scratch: Scratch, seed: int = 0) -> Blocks:
    """Numbered points in blocks; another seed samples other pivots."""
    rows, n, length = points
    count = min(PIVOTS, max(1, -(-n // BLOCK)))
    sampled = [r.v for r in rows.orderBy(F.xxhash64("p", F.lit(seed)), "p").limit(count).select("v").collect()]
    pivots = np.array(sampled, dtype=np.float64).reshape(len(sampled), length)
    size = -(-n // count)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(pa.chunked_array([batch.column("v")]))
            at = np.concatenate([_gaps(v[s], pivots)[0].argmin(axis=1) for s in _sliced(len(v), len(pivots))]) if len(v) else np.zeros(0, np.int64)
            away = np.sqrt(((v - pivots[at]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at, pa.int32()), pa.array(away)], names=["p", "id", "v", "pivot", "away"])

    id_type = rows.schema["id"].dataType.simpleString()
    placed = scratch.kept(rows.mapInArrow(place, f"p long, id {id_type}, v array<double>, pivot int, away double"))
    parts = placed.groupBy("pivot").agg(F.ceil(F.count("*") / (2 * max(1, size))).alias("parts"))  # a row for each pivot
    placed = placed.join(F.broadcast(parts), "pivot").withColumn("block", F.shiftleft(F.pmod(F.xxhash64("p"), F.col("parts")), 13) + F.col("pivot"))
    placed = scratch.kept(placed.select("p", "id", "block", "v", "pivot", "away"))
    balls = placed.groupBy("block").agg(F.max("pivot").alias("pivot"), F.max("away").alias("radius")).orderBy("block").collect()
    at = np.array([b.pivot for b in balls], np.int64)
    block, radius = np.array([b.block for b in balls], np.int64), np.array([b.radius for b in balls]) * (1 + 1e-9)
    side = min(max(BLOCK, n // 8), SIDE)
    group = np.arange(len(balls)) // max(1, round(side * len(balls) / max(1, n)))
    groups = rows.sparkSession.createDataFrame([(int(b), int(g)) for b, g in zip(block, group)], "block long, grp long")  # a row for each block
    return Blocks(placed.select("p", "id", "block", "v").join(F.broadcast(groups), "block").select("p", "id", "block", "grp", "v"), Balls(block, pivots[at], radius, group), side, n)


def segments(x: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """Each block of a group's points."""
    block = x.column("block").to_numpy()
    x, block = x.take(pa.array(np.argsort(block, kind="stable"))), np.sort(block)
    starts = np.nonzero(np.diff(block, prepend=-1))[0]
    return ((int(block[a]), x.slice(a, b - a)) for a, b in zip(starts, [*starts[1:], len(block)]))


def visited(points: DataFrame, asked: DataFrame, side: int, kernel: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``kernel(asked, points)`` for each group and each ``side`` of those that ask in it, so a task holds a bounded number of both."""
    chunks = asked.groupBy("grp").agg(F.ceil(F.count("*") / side).alias("chunks"))  # a row for each group
    q = asked.join(F.broadcast(chunks), "grp").withColumn("chunk", F.pmod(F.xxhash64("p"), F.col("chunks"))).drop("chunks")
    q = q.select(*[F.col(c).alias(f"q_{c}") for c in q.columns])
    x = points.join(F.broadcast(chunks), "grp").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1))).drop("chunks")
    run = lambda a, b: kernel(a.rename_columns([c.removeprefix("q_") for c in a.column_names]), b)
    return q.groupBy("q_grp", "q_chunk").cogroup(x.groupBy("grp", "chunk")).applyInArrow(run, schema)


def neighbours(blocks: Blocks, k: int, scratch: Scratch, exact: bool = True) -> DataFrame:
    """``(p, q, d)``: the k nearest other points of each (all, if fewer), by distance, then number; those of its block, if not ``exact``."""
    from pyspark.sql import Window

    balls, schema, names = blocks.balls, "p long, q long, d double", ["p", "q", "d"]

    def listed(lists: Lists) -> pa.Table:
        r, q, d = lists.found()
        return pa.table([lists.own[r], q, d], names=names)

    def within(t: pa.Table) -> pa.Table:
        """Own blocks first, then the others of the group."""
        parts, lists = [x for _, x in segments(t)], []
        for x in parts:
            v, ids = matrix(x.column("v")), x.column("p").to_numpy()
            lists.append(Lists(v, ids, k, np.full(len(v), np.inf)))
            lists[-1].offer(np.arange(len(v)), v, ids)
        if exact:
            of = [int(x.column("block")[0].as_py()) for x in parts]
            for i, own in enumerate(lists):
                for j, x in enumerate(lists):
                    if i != j and len(rows := balls.reached(own.q, own.most, of[j])):
                        own.offer(rows, x.q, x.own)
        return pa.concat_tables([listed(x) for x in lists])

    def pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"p": pa.array([], pa.int64()), "q": pa.array([], pa.int64()), "d": pa.array([], pa.float64())})
        lists = Lists(matrix(a.column("v")), a.column("p").to_numpy(), k, a.column("most").to_numpy())
        for block, x in segments(b):
            if len(rows := balls.reached(lists.q, lists.most, block)):
                lists.offer(rows, matrix(x.column("v")), x.column("p").to_numpy())
        return listed(lists)

    points = blocks.points.select("p", "block", "grp", "v")
    inside = scratch.kept(points.groupBy("grp" if exact else "block").applyInArrow(within, schema))
    if not exact:
        return inside
    found = inside
    if balls.group[-1:].any():
        reach = inside.groupBy("p").agg(F.when(F.count("*") >= k, F.max("d")).alias("reach"))
        rows = points.join(reach, "p", "left").select("p", "grp", "v", F.coalesce("reach", F.lit(float("inf"))).alias("most"))
        found = inside.union(visited(points, scratch.kept(_sent(rows, balls)), blocks.side, pairs, schema))
    place = F.row_number().over(Window.partitionBy("p").orderBy("d", "q"))
    return found.withColumn("place", place).where(F.col("place") <= k).drop("place")


def _sent(rows: DataFrame, balls: Balls, own_too: bool = False) -> DataFrame:
    """``rows(p, grp, v, most, ...)`` once for each other group, or each if ``own_too``, with a block that may hold something within ``most``."""
    center, radius, group = balls.center, balls.radius, balls.group
    starts = np.nonzero(np.diff(group, prepend=-1))[0]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, own, most = matrix(pa.chunked_array([batch.column("v")])), batch.column("grp").to_numpy(), batch.column("most").to_numpy()
            for s in _sliced(len(v), len(center)):
                gap, slack = _gaps(v[s], center)
                bound = np.sqrt(np.maximum(gap, 0)) - radius[None, :] - np.sqrt(slack)
                go = np.logical_or.reduceat(bound <= most[s][:, None], starts, axis=1)
                if not own_too:
                    go &= own[s][:, None] != group[starts][None, :]
                r, c = np.nonzero(go)
                part = batch.take(pa.array(r + s.start))
                yield part.set_column(part.schema.get_field_index("grp"), "grp", pa.array(group[starts][c]))

    return rows.mapInArrow(send, rows.schema)

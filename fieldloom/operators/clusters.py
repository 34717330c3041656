"""ANA-EMBED, clusters: density clusters with noise (HDBSCAN) as Spark jobs.

1. The core distance of a point is that to its ``min_samples``-th other point; the weight of a pair is the largest of both cores
   and their distance. Pairs are ordered by weight, then by their ends, so everything below is unique.
2. A minimum spanning tree: each component takes its least edge to another, the components so joined become one. Lists of
   nearest neighbours tell most of these edges and that they are least; points that they leave open are searched for
   among the strangers in blocks within their component's least edge so far. Boruvka rounds over the tree's edges follow.
3. The hierarchy from the rounds: an edge belongs to the chain of the first later component that it is below the least edge
   of; a chain, in order, is a spine of the dendrogram, and hangs on that least edge. So sizes are running sums along chains, and
   a few joins for each of the (logarithmically many) rounds replace the walk over all edges.
4. Condensed tree: an edge with at least ``min_cluster_size`` points on both sides splits a cluster; points that leave in
   smaller groups leave at that edge. A cluster's stability is the sum over its points of 1 / distance where they leave less
   that where it begins; clusters that are at least as stable as the best choice beneath them are chosen, never the root.

Distances under 1e-12 count as that. Points in no chosen cluster are noise, -1; the others are numbered by their least point.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldloom.sources.scratch import Scratch

from . import neighbours as N
from .ranges import numbered

EDGE = ("w", "lo", "hi")
#: Neighbours that are listed of each point at least: most edges of the tree are among them.
LISTED = 16


def _edge(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c).alias(c) for c in EDGE])


def _kept(scratch: Scratch, df: DataFrame, *names: str) -> DataFrame:
    return scratch.kept(df.select(*names) if names else df)


def _roots(picks: DataFrame, scratch: Scratch) -> DataFrame:
    """``(comp, next)`` of the components ``(comp, other)`` that took an edge, and of those they end at: the component that all so joined become.

    Of two that take the same edge the smaller is the root; a component that took none is one; all others reach it by doubling their steps.
    """
    back = picks.select(F.col("comp").alias("other"), F.col("other").alias("again"))
    own = F.when(F.col("again").isNull() | (F.col("again") != F.col("comp")) | (F.col("comp") > F.col("other")), F.col("other")).otherwise(F.col("comp"))
    ends = picks.select(F.col("other").alias("comp")).distinct().join(picks, "comp", "left_anti").select("comp", F.col("comp").alias("next"))
    hop = _kept(scratch, picks.select("comp", "other").join(back, "other", "left").select("comp", own.alias("next")).union(ends))
    while True:
        far = hop.select(F.col("comp").alias("next"), F.col("next").alias("then"))
        moved = _kept(scratch, hop.join(far, "next").select("comp", F.col("then").alias("next"), (F.col("then") != F.col("next")).alias("moved")))
        hop = moved.select("comp", "next")
        if not moved.where("moved").limit(1).count():
            return hop


def _least(edges: DataFrame) -> DataFrame:
    """``(comp, w, lo, hi, other)``: the least edge of each component, of ``edges(a, b, w, lo, hi)`` between components."""
    ends = F.explode(F.array(*[F.struct(F.col(x).alias("comp"), *EDGE, F.col(y).alias("other")) for x, y in ("ab", "ba")]))
    return edges.select(ends.alias("e")).select("e.*").groupBy("comp").agg(F.min(F.struct(*EDGE, "other")).alias("e")).select("comp", "e.*")


def _relabelled(edges: DataFrame, hop: DataFrame) -> DataFrame:
    """``edges(a, b, w, lo, hi)`` between the components they join now; those inside one are left out."""
    for x in ("a", "b"):
        edges = edges.join(hop.select(F.col("comp").alias(x), "next"), x, "left").withColumn(x, F.coalesce("next", x)).drop("next")
    return edges.where("a <> b").select("a", "b", *EDGE)


def spanning_tree(blocks: N.Blocks, lists: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """``(w, lo, hi)``: the edges of the minimum spanning tree, from ``lists(p, q, d)``, the same number of nearest others of each point, ``k`` at least.

    What isn't on a point's list comes after the last of it: ``floor`` is an edge that all of a point's other edges come after. So a component's least edge of
    the lists is its least of all if no floor of its points comes before it. Only where few components are so sure, points whose floor does are searched for
    among all points, except those of the largest component, which needn't take an edge: the others join it.
    """
    listed = lists.groupBy("p").agg(F.sort_array(F.collect_list(F.struct("d", "q"))).alias("n"))  # a list is short
    last, endless = F.element_at("n", -1), F.size("n") >= blocks.n - 1
    floor = F.when(~endless, F.struct(last["d"].alias("w"), F.least("p", last["q"]).alias("lo"), F.greatest("p", last["q"]).alias("hi")))
    listed = _kept(scratch, listed.select("p", F.get("n", F.lit(k - 1))["d"].alias("core"), floor.alias("floor")))
    cores = listed.select("p", "core")
    far = cores.select(F.col("p").alias("q"), F.col("core").alias("far"))
    edges = lists.join(cores, "p").join(far, "q").select(F.col("p").alias("a"), F.col("q").alias("b"), F.greatest("d", "core", "far").alias("w"), F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"))
    edges = _kept(scratch, edges.dropDuplicates(["lo", "hi"]))
    points = _kept(scratch, listed.select("p", F.col("p").alias("comp"), "core", "floor"))
    balls, schema = blocks.balls, "a long, b long, w double, lo long, hi long"

    def search(a: pa.Table, b: pa.Table) -> pa.Table:
        take = lambda t, c: t.column(c).to_numpy()
        q, most, found = N.matrix(a.column("v")), take(a, "most").copy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        b = b.take(pa.array(np.argsort(take(b, "block"), kind="stable"))) if b.num_rows else b
        start = 0
        for block, x in N.segments(b) if a.num_rows else ():
            rows = balls.reached(q, most, block)
            if len(rows):
                own = a.take(pa.array(rows)).drop_columns("most").append_column("most", pa.array(most[rows]))
                r, c, w = N.strangers(own, x)
                most[rows[r]] = np.minimum(most[rows[r]], w)
                found.append((rows[r], c + start, w))
            start += x.num_rows
        r, c, w = (np.concatenate(v) for v in zip(*found))
        comp, p, q = take(a, "comp")[r], take(a, "p")[r], take(b, "p")[c]
        lo, hi = np.minimum(p, q), np.maximum(p, q)
        o = np.lexsort((hi, lo, w, comp))
        o = o[np.arange(len(o)) == np.searchsorted(comp[o], comp[o])]  # one for each component
        return pa.table([comp[o], take(b, "comp")[c][o], w[o], lo[o], hi[o]], names=["a", "b", "w", "lo", "hi"])

    tree = None
    while True:
        comps = points.groupBy("comp").agg(F.count("*").alias("size"), F.min("floor").alias("floor"))
        best = _kept(scratch, comps.join(_least(edges), "comp", "left").withColumn("sure", F.col("w").isNotNull() & (F.col("floor").isNull() | (_edge() <= F.col("floor")))))
        count = best.agg(F.count("*").alias("n"), F.count_if("sure").alias("sure"), F.max(F.struct("size", "comp")).alias("top")).first()
        if count.n == 1:
            return tree
        if count.sure * 4 < count.n:
            asks = points.join(best.where((F.col("comp") != count.top.comp) & ~F.col("sure")).select("comp", F.when(F.col("w").isNotNull(), _edge()).alias("e")), "comp").where(F.col("e").isNull() | (F.col("floor") < F.col("e")))
            rows = blocks.points.select("p", "block", "grp", "v")
            asks = rows.join(asks.select("p", "core", "comp", F.coalesce("e.w", F.lit(float("inf"))).alias("most")), "p").select("p", "grp", "v", "core", "comp", "most")
            among = rows.join(points.select("p", "core", "comp"), "p")
            new = _kept(scratch, N.visited(among, _kept(scratch, N._sent(asks, balls, own_too=True)), blocks.side, search, schema))
            # what was found is least for the component that looked, and an edge like others for the one it ends at
            edges = _kept(scratch, edges.union(new))
            best = _least(edges).join(best.select("comp", "sure"), "comp").withColumn("sure", F.col("sure") | (F.col("comp") != count.top.comp))
        picks = _kept(scratch, best.where("sure").select("comp", *EDGE, "other"))
        found = picks.select(*EDGE).distinct()
        tree = found if tree is None else tree.union(found)
        hop = _roots(picks, scratch)
        points = _kept(scratch, points.join(hop, "comp", "left").select("p", F.coalesce("next", "comp").alias("comp"), "core", "floor"))
        edges = _kept(scratch, _relabelled(edges, hop))


def spanning_rounds(tree: DataFrame, n: int, scratch: Scratch) -> list[tuple[DataFrame, DataFrame]]:
    """Boruvka rounds over the edges of a spanning tree of ``n`` points: ``(comp, w, lo, hi)`` of each component's least edge, and ``(comp, next)``.

    A component's least edge is in the tree, so the rounds are those of all pairs.
    """
    edges, rounds, count = _kept(scratch, tree.select(F.col("lo").alias("a"), F.col("hi").alias("b"), *EDGE)), [], n
    while count > 1:
        best = _kept(scratch, _least(edges))
        hop = _roots(best.select("comp", "other"), scratch)
        rounds.append((best.select("comp", *EDGE), hop))
        edges = _kept(scratch, _relabelled(edges, hop))
        count = hop.select("next").distinct().count()
    return rounds


def chains(rounds: list[tuple[DataFrame, DataFrame]], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The dendrogram: ``(level, comp, w, lo, hi, round, idx, side, wide, upto)`` of each edge, and the edge ``(level, comp, u)`` that each chain hangs on.

    ``side`` are the points beneath it that aren't in the chain so far, ``wide`` the larger part of those (the first edge of a chain has two), ``upto``
    all points beneath it.
    """
    top = len(rounds)
    done, waiting = None, None
    for level in range(1, top + 1):
        best, hop = rounds[level - 1]
        fresh = best.join(hop, "comp").groupBy(*EDGE).agg(F.max("next").alias("at")).withColumn("round", F.lit(level - 1))
        rows = fresh if waiting is None else fresh.union(waiting.join(hop.withColumnRenamed("comp", "at"), "at").select(*EDGE, F.col("next").alias("at"), "round"))
        if level == top:
            own, waiting = rows, None
        else:
            rows = _kept(scratch, rows.join(rounds[level][0].select(F.col("comp").alias("at"), _edge().alias("u")), "at").withColumn("e", _edge()))
            own, waiting = rows.where("e < u"), rows.where("e > u").select(*EDGE, "at", "round")
        own = own.select(F.lit(level).alias("level"), F.col("at").alias("comp"), *EDGE, "round")
        done = own if done is None else done.union(own)
    done = _kept(scratch, done)
    hangs, sides, total = None, None, None
    for level, (best, _) in enumerate(rounds):
        points = best.withColumn("total", F.lit(1).cast("long")) if level == 0 else best.join(total, "comp")
        side = _kept(scratch, points.groupBy(*EDGE).agg(F.sum("total").alias("side"), F.max("total").alias("wide")))
        hang = best.select(F.lit(level).alias("level"), "comp", _edge().alias("u"))
        hangs, sides = (hang, side) if hangs is None else (hangs.union(hang), sides.union(side))
        if level + 1 < top:
            total = _kept(scratch, done.where(F.col("level") == level + 1).join(sides, list(EDGE)).groupBy("comp").agg(F.sum("side").alias("total")))
    rows = done.join(sides, list(EDGE)).withColumn("chain", F.concat_ws(":", "level", "comp"))
    return _kept(scratch, numbered(rows, "chain", list(EDGE), "side", scratch=scratch).drop("n")), hangs


def condensed(tree: DataFrame, hangs: DataFrame, rounds: list, size: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Clusters ``(c, parent, birth, size, stability)`` and points ``(p, c, leave)``; a cluster is named by its lowest edge, as text."""
    top = len(rounds)
    name = F.to_json(_edge())
    chain_of = lambda level, comp: F.concat_ws(":", level, comp)
    before, other = F.col("upto") - F.col("side"), F.col("side") - F.col("wide")
    # the two parts beneath an edge: the chain so far and the side, or the two sides of a chain's first edge
    a, b = F.when(F.col("idx") == 0, F.col("wide")).otherwise(F.col("side")), F.when(F.col("idx") == 0, other).otherwise(before)
    big, big_a, big_b = F.col("upto") >= size, a >= size, b >= size
    kind = F.when(~big, None).when(big_a & big_b, "split").when(~big_a & ~big_b, "birth").when((F.col("idx") == 0) | big_a, "take")
    marked = tree.withColumn("kind", kind).withColumn("event", F.col("kind").isNotNull().cast("long")).drop("idx").withColumnRenamed("upto", "size")
    marked = _kept(scratch, numbered(marked, "chain", list(EDGE), "event", scratch=scratch).drop("n").withColumnRenamed("upto", "ordinal"))
    # what a chain's last edge belongs to, from the lowest level up; "take" goes on with the cluster of the large side
    sides = hangs.where("level > 0").select(chain_of("level", "comp").alias("side_chain"), F.col("u.w").alias("w"), F.col("u.lo").alias("lo"), F.col("u.hi").alias("hi"))
    events, ends = None, None
    for level in range(1, top + 1):
        own = marked.where((F.col("level") == level) & F.col("kind").isNotNull())
        at = own.select("chain", "ordinal", "kind", name.alias("own"), *EDGE)
        if ends is not None:
            taken = sides.join(ends.select(F.col("chain").alias("side_chain"), F.col("c").alias("from")), "side_chain").groupBy(*EDGE).agg(F.collect_list("from").alias("from"))  # two at most
            at = at.join(taken, list(EDGE), "left")
        else:
            at = at.withColumn("from", F.array().cast("array<string>"))
        c = F.when(F.col("kind") == "take", F.get("from", F.lit(0))).otherwise(F.col("own"))
        at = _kept(scratch, at.select("chain", "ordinal", "kind", "own", F.coalesce("from", F.array().cast("array<string>")).alias("from"), c.alias("c"), *EDGE))
        last = at.groupBy("chain").agg(F.max_by("c", "ordinal").alias("c"))
        events, ends = (at, last) if events is None else (events.union(at), ends.union(last))
    events = _kept(scratch, events)
    # children of a split: the clusters of its large sides, and of the chain so far
    prior = events.select("chain", (F.col("ordinal") + 1).alias("ordinal"), F.col("c").alias("prior"))
    split = events.where("kind = 'split'").join(prior, ["chain", "ordinal"], "left")
    kids = F.when(F.size("from") < 2, F.array_append("from", F.col("prior"))).otherwise(F.col("from"))
    parents = split.select(F.explode(kids).alias("c"), F.col("own").alias("parent"), F.col("w").alias("birth"))
    # each point leaves at the first large edge above it
    owned = marked.where("size >= %d" % size).join(events.select("chain", "ordinal", "c"), ["chain", "ordinal"])
    large = _kept(scratch, owned.select("chain", *EDGE, F.struct(F.col("c"), F.col("w").alias("leave"), "size").alias("g")))
    first = large.groupBy("chain").agg(F.min_by("g", _edge()).alias("g"))
    ups = hangs.where("level > 0").select(chain_of("level", "comp").alias("chain"), F.col("u.w").alias("w"), F.col("u.lo").alias("lo"), F.col("u.hi").alias("hi"), "level")
    where = marked.select(*EDGE, F.col("chain").alias("in_chain"))
    goes = first
    for level in range(top - 1, 0, -1):
        small = ups.where(F.col("level") == level).join(first, "chain", "left_anti").join(where, list(EDGE))
        found = small.join(large.drop("chain").withColumnRenamed("g", "direct"), list(EDGE), "left").join(goes.select(F.col("chain").alias("in_chain"), F.col("g").alias("later")), "in_chain", "left")
        goes = goes.union(_kept(scratch, found.select("chain", F.coalesce("direct", "later").alias("g"))))
    at = rounds[0][0].select(F.col("comp").alias("p"), *EDGE).join(where, list(EDGE)).join(large.drop("chain").withColumnRenamed("g", "direct"), list(EDGE), "left")
    at = at.join(goes.select(F.col("chain").alias("in_chain"), F.col("g").alias("later")), "in_chain", "left").select("p", F.coalesce("direct", "later").alias("g"))
    points = _kept(scratch, at.select("p", F.col("g.c").alias("c"), F.col("g.leave").alias("leave")))
    rate = lambda w: 1 / F.greatest(w, F.lit(1e-12))
    left = points.where("c IS NOT NULL").groupBy("c").agg(F.count("*").alias("n"), F.sum(rate(F.col("leave"))).alias("rates"))
    ends = marked.where("kind = 'split'").select(name.alias("c"), F.col("size").alias("n"), (F.col("size") * rate(F.col("w"))).alias("rates"))
    own = left.union(ends).groupBy("c").agg(F.sum("n").alias("size"), F.sum("rates").alias("rates")).join(parents, "c", "left")
    birth = F.coalesce(rate(F.col("birth")), F.lit(0.0))
    return _kept(scratch, own.select("c", "parent", "birth", "size", (F.col("rates") - F.col("size") * birth).alias("stability"))), points


def worth(clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """``(c, parent, best)``: the best choice from each cluster down, the larger of its own stability and the sum of its two parts' best.

    With one part known, a cluster's best is ``max(a, best of the other + b)``. Such steps put together are such a step again, so a chain of clusters is resolved by
    doubling, whatever its length. Each round resolves all chains that end at a known one, so what remains halves at least: no round for each level of the tree.
    """
    parents = clusters.where("parent IS NOT NULL").select(F.col("parent").alias("c")).distinct()
    known = _kept(scratch, clusters.join(parents, "c", "left_anti").select("c", "parent", F.col("stability").alias("best")))
    waiting = _kept(scratch, clusters.join(parents, "c", "left_semi").select("c", "parent", "stability"))
    while waiting.limit(1).count():
        sums = known.where("parent IS NOT NULL").groupBy(F.col("parent").alias("c")).agg(F.count("*").alias("n"), F.sum("best").alias("b"))
        part = waiting.where("parent IS NOT NULL").select(F.col("parent").alias("c"), F.col("c").alias("at"))
        rows = waiting.join(sums, "c").join(part, "c", "left")
        step = _kept(scratch, rows.select("c", "parent", "at", F.col("stability").alias("a"), "b", F.when(F.col("n") == 2, F.greatest("stability", "b")).alias("best")))
        while True:
            far = step.select(F.col("c").alias("at"), F.col("at").alias("at2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("best").alias("best2"))
            on = F.col("best").isNull() & F.col("best2").isNull() & F.col("at2").isNotNull()
            best = F.coalesce("best", F.when(F.col("best2").isNotNull(), F.greatest("a", F.col("best2") + F.col("b"))))
            at, a, b = F.when(on, F.col("at2")).otherwise(F.col("at")), F.when(on, F.greatest("a", F.col("a2") + F.col("b"))).otherwise(F.col("a")), F.when(on, F.col("b") + F.col("b2")).otherwise(F.col("b"))
            moved = on | (F.col("best").isNull() & F.col("best2").isNotNull())
            step = _kept(scratch, step.join(far, "at", "left").select("c", "parent", at.alias("at"), a.alias("a"), b.alias("b"), best.alias("best"), moved.alias("moved")))
            if not step.where("moved").limit(1).count():
                break
        known = _kept(scratch, known.union(step.where("best IS NOT NULL").select("c", "parent", "best")))
        waiting = _kept(scratch, waiting.join(known, "c", "left_anti"))
    return known


def chosen(clusters: DataFrame, scratch: Scratch) -> DataFrame:
    """``(c, cluster)``: the chosen cluster that each cluster is in, if any."""
    below = worth(clusters, scratch).where("parent IS NOT NULL").groupBy(F.col("parent").alias("c")).agg(F.sum("best").alias("below"))
    taken = F.col("parent").isNotNull() & (F.col("below").isNull() | (F.col("stability") >= F.col("below")))
    value = _kept(scratch, clusters.join(below, "c", "left").select("c", "parent", taken.alias("taken")))
    # the topmost chosen one on the way up, by doubling
    up = value.select("c", F.col("parent").alias("at"), F.when(F.col("taken"), F.col("c")).alias("cluster"))
    while up.where("at IS NOT NULL").limit(1).count():
        far = up.select(F.col("c").alias("at"), F.col("at").alias("then"), F.col("cluster").alias("higher"))
        up = _kept(scratch, up.join(far, "at", "left").select("c", F.col("then").alias("at"), F.coalesce("higher", "cluster").alias("cluster")))
    return up.select("c", "cluster")


def hdbscan(vectors: DataFrame, min_cluster_size: int = 5, min_samples: int | None = None) -> DataFrame:
    """``(id, cluster)`` of each row of ``(id, v array)``; see ``neighbours.numbered_points`` for rows that don't count.

    Fewer rows than ``min_cluster_size`` are all noise; so is everything where no split occurs. Repeated rows are points of their own.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has two points at least")
    scratch = Scratch(vectors.sparkSession, "clusters")
    points = N.numbered_points(vectors, scratch)
    ids = points[0].select("p", "id")
    if points[1] < max(2, min_cluster_size):
        return ids.select("id", F.lit(-1).cast("long").alias("cluster"))
    blocks = N.dealt(points, scratch)
    k = min(min_samples or min_cluster_size, blocks.n - 1)
    lists = _kept(scratch, N.neighbours(blocks, min(max(k, LISTED), blocks.n - 1), scratch))
    rounds = spanning_rounds(spanning_tree(blocks, lists, k, scratch), blocks.n, scratch)
    tree, hangs = chains(rounds, scratch)
    clusters, points = condensed(tree, hangs, rounds, min_cluster_size, scratch)
    found = _kept(scratch, points.join(chosen(clusters, scratch), "c", "left").select("p", "cluster"))
    order = found.where("cluster IS NOT NULL").groupBy("cluster").agg(F.min("p").alias("first")).withColumn("all", F.lit(""))
    order = numbered(order, "all", ["first"], scratch=scratch).select("cluster", F.col("idx").alias("number"))
    return ids.join(found.join(order, "cluster", "left"), "p").select("id", F.coalesce("number", F.lit(-1).cast("long")).alias("cluster"))

"""Density clusters against a plain walk over all pairs."""

from __future__ import annotations

import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import clusters as C
from fieldloom.operators import neighbours as N
from fieldloom.operators.ranges import numbered


def plain(v, m, k):
    """Labels by sorting all pairs: merges one after the other, condensed tree, most stable clusters."""
    v = np.asarray(v, float)
    n = len(v)
    if n < max(2, m):
        return [-1] * n
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    k = min(k or m, n - 1)
    core = np.array([sorted(np.delete(d[i], i))[k - 1] for i in range(n)])
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])
    pairs = sorted((reach[i, j], i, j) for i in range(n) for j in range(i + 1, n))
    of, nodes = list(range(n)), {i: ([i], None, None, None) for i in range(n)}

    def root(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for w, i, j in pairs:
        a, b = root(i), root(j)
        if a != b:
            of.append(len(of))
            of[a] = of[b] = len(of) - 1
            nodes[len(of) - 1] = (nodes[a][0] + nodes[b][0], w, a, b)
    rate = lambda w: 1 / max(w, 1e-12)
    clusters = []

    def walk(node, birth, parent):
        me = len(clusters)
        clusters.append({"parent": parent, "kids": [], "points": nodes[node][0], "stability": 0.0})
        if parent is not None:
            clusters[parent]["kids"].append(me)
        while True:
            points, w, a, b = nodes[node]
            big = [x for x in (a, b) if len(nodes[x][0]) >= m]
            small = sum(len(nodes[x][0]) for x in (a, b) if len(nodes[x][0]) < m)
            if len(big) == 1:
                clusters[me]["stability"] += small * (rate(w) - birth)
                node = big[0]
                continue
            clusters[me]["stability"] += len(points) * (rate(w) - birth)
            for x in big:
                walk(x, rate(w), me)
            return

    walk(len(of) - 1, 0.0, None)

    def best(c):
        below = [best(x) for x in clusters[c]["kids"]]
        total, picked = sum(x for x, _ in below), [y for _, own in below for y in own]
        own = clusters[c]["stability"]
        return (own, [c]) if clusters[c]["parent"] is not None and own >= total else (max(total, own), picked)

    label = [-1] * n
    for number, c in enumerate(sorted(best(0)[1], key=lambda c: min(clusters[c]["points"]))):
        for p in clusters[c]["points"]:
            label[p] = number
    return label


def blobs(seed, n, dim, parts, spread):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(parts, dim)) * 5
    return [(centers[i % parts] + r.normal(size=dim) * spread * (1 + i % parts)).tolist() if i % 9 else (r.normal(size=dim) * 8).tolist() for i in range(n)]


def labels(spark, v, **kw):
    df = spark.createDataFrame([(i, list(map(float, x)), 1) for i, x in enumerate(v)], "id long, v array<double>, p int").repartition(3)
    got = {r.id: r.cluster for r in C.hdbscan(df, **kw).collect()}
    return [got[i] for i in range(len(v))]


@pytest.mark.parametrize(("block", "pivots"), [(60, 4096), (40, 3)])
def test_equals_a_plain_walk(spark, monkeypatch, block, pivots):
    """500 vectors in many blocks, and in crowded ones."""
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PIVOTS", pivots)
    v = blobs(1, 500, 6, 5, 0.6)
    want = plain(v, 8, None)
    assert labels(spark, v, min_cluster_size=8) == want
    assert len(set(want)) >= 4 and -1 in want


@pytest.mark.parametrize("seed", [2, 3])
def test_ties_and_copies(spark, seed):
    """Whole coordinates: many equal distances and equal points."""
    r = random.Random(seed)
    v = [[r.choice((0, 9)) + r.randrange(3), r.choice((0, 9)) + r.randrange(3)] for _ in range(110)]
    assert labels(spark, v, min_cluster_size=4, min_samples=2) == plain(v, 4, 2)


def test_short_lists_and_large_groups(spark, monkeypatch):
    """Groups apart and copies that are more than the lists hold: edges that no list has."""
    monkeypatch.setattr(N, "BLOCK", 40)
    monkeypatch.setattr(C, "LISTED", 3)
    r = np.random.default_rng(7)
    v = [*(r.normal(size=(60, 3)) + 40).tolist(), *(r.normal(size=(50, 3)) - 40).tolist(), *[[0.0, 0.0, 0.0]] * 30, *[[0.5, 0.0, 0.0]] * 25, *r.normal(size=(40, 3)).tolist()]
    assert labels(spark, v, min_cluster_size=5, min_samples=2) == plain(v, 5, 2)


def test_deep_trees_take_few_rounds(spark):
    """A tree of 151 levels, each with a leaf and a small tree beside the rest: the steps don't grow with its height."""
    from fieldloom.sources.scratch import Scratch

    r = random.Random(5)
    rows, kids = [("0", None)], {}
    for i in range(150):
        pair = [str(i + 1), f"leaf{i}"]
        kids[str(i)] = pair
        rows += [(c, str(i)) for c in pair]
        if i % 3 == 0:
            kids[f"leaf{i}"] = [f"leaf{i}a", f"leaf{i}b"]
            rows += [(c, f"leaf{i}") for c in kids[f"leaf{i}"]]
    own = {c: float(r.randrange(1, 9) * (40 if c.isdigit() and r.random() < 0.1 else 1)) for c, _ in rows}
    want, best = {}, {}
    for c, _ in reversed(rows):  # parts come after what they are parts of
        below = sum(best[x] for x in kids[c]) if c in kids else None
        best[c] = own[c] if below is None else max(own[c], below)
        want[c] = own[c] >= (below or 0)
    top = {"0": None}
    for c, parent in rows[1:]:
        top[c] = top[parent] or (c if want[c] else None)
    scratch = Scratch(spark, "t")
    df = spark.createDataFrame([(c, p, own[c]) for c, p in rows], "c string, parent string, stability double")
    assert {x.c: x.cluster for x in C.chosen(df, scratch).collect()} == top
    assert scratch.n < 50 and len(set(top.values())) > 5


def test_few_and_odd_rows(spark):
    schema = "id long, v array<double>"
    assert C.hdbscan(spark.createDataFrame([], schema)).count() == 0
    assert labels(spark, [[1.0], [2.0]]) == [-1, -1]
    assert labels(spark, [[float(i)] for i in range(20)], min_cluster_size=3) == plain([[i] for i in range(20)], 3, None)
    rows = [(i, [float(i % 2) * 9, float(i)]) for i in range(30)] + [(None, [1.0, 1.0]), (99, None), (98, [float("nan"), 0.0]), (97, [None, 1.0]), (96, [1.0])]
    got = C.hdbscan(spark.createDataFrame(rows, schema), 3).collect()
    assert sorted(r.id for r in got) == list(range(30))
    with pytest.raises(ValueError):
        C.hdbscan(spark.createDataFrame([], schema), 1)


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 30)
    from fieldloom.sources.scratch import Scratch

    v = np.array(blobs(4, 300, 5, 4, 0.5))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    scratch = Scratch(spark, "t")
    got = N.neighbours(N.dealt(N.numbered_points(df, scratch), scratch), 7, scratch).groupBy("p").agg(F.sort_array(F.collect_list(F.struct("d", "q"))).alias("n")).collect()
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    for r in got:
        want = sorted((d[r.p, j], j) for j in range(300) if j != r.p)[:7]
        assert [x.q for x in r.n] == [j for _, j in want] and all(math.isclose(x.d, w) for x, (w, _) in zip(r.n, want))
    assert len(got) == 300
    path = scratch.path
    scratch.drop()
    assert not os.path.exists(path)


def test_places(spark):
    rows = [("hot", i % 3, i) for i in range(50)] + [("b", None, 7), ("b", 1, 8)] + [("hot", 1, 1)] * 20
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = numbered(df, "g", ["k"], "v", aim=9).collect()
    for g in ("hot", "b"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.idx)
        assert [r.idx for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [r.upto for r in own] == np.cumsum([r.v for r in own]).tolist()
    assert numbered(df.limit(0), "g", ["k"]).count() == 0


def test_points_travel_by_groups(spark, monkeypatch):
    """Where no ball prunes, a point is sent to each group of blocks, not to each block, and lists are those of all pairs."""
    from fieldloom.sources.scratch import Scratch

    monkeypatch.setattr(N, "BLOCK", 20)
    r = np.random.default_rng(3)
    v = r.normal(size=(640, 64))
    v[100:110] = v[5]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>")
    scratch, sent = Scratch(spark, "t"), []
    plain_sent = N._sent
    monkeypatch.setattr(N, "_sent", lambda *a, **kw: sent.append(scratch.kept(plain_sent(*a, **kw))) or sent[-1])
    blocks = N.dealt(N.numbered_points(df, scratch), scratch)
    got = {x.p: [y.q for y in x.n] for x in N.neighbours(blocks, 7, scratch).groupBy("p").agg(F.sort_array(F.collect_list(F.struct("d", "q"))).alias("n")).collect()}
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    assert all(got[i] == [j for _, j in sorted((d[i, j], j) for j in range(640) if j != i)[:7]] for i in range(640))
    assert len(blocks.block) > 20 and sent[0].count() <= 640 * 9


@pytest.mark.parametrize(("dim", "off"), [(64, 0.0), (64, 1000.0), (20, 3.0), (2, 0.0)])
def test_lists_in_single_precision(dim, off):
    r = np.random.default_rng(1)
    v = r.normal(size=(900, dim))
    v[100:140] = v[5]
    v, ids = v + off, r.permutation(900)
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1))
    lists = N.Lists(v, ids, 7, np.full(900, np.inf))
    for a in range(0, 900, 300):
        lists.offer(np.arange(900), v[a : a + 300], ids[a : a + 300])
    rows, near, _ = lists.found()
    for i in range(900):
        assert near[rows == i].tolist() == [j for _, j in sorted((d[i, j], ids[j]) for j in range(900) if j != i)[:7]]

"""Neighbour graph and layout against all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import layout as L
from fieldloom.operators import neighbours as N
from fieldloom.sources.scratch import Scratch


def frame(spark, v):
    return spark.createDataFrame([(i, list(map(float, x))) for i, x in enumerate(v)], "id long, v array<double>").repartition(3)


def ranks(v):
    d = ((v[:, None] - v[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return d.argsort(axis=1)


def trustworthiness(v, y, k=10):
    """Share, from 0 to 1, by which neighbours in ``y`` are neighbours in ``v``."""
    n, order, near = len(v), ranks(v), ranks(y)[:, :k]
    rank = np.empty_like(order)
    rank[np.arange(n)[:, None], order] = np.arange(n)[None, :] + 1
    off = np.maximum(rank[np.arange(n)[:, None], near] - k, 0).sum()
    return 1 - off * 2 / (n * k * (2 * n - 3 * k - 1))


@pytest.fixture(scope="module")
def vectors(spark, sf_dir):
    got = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    return np.array([r.embedding for r in got], float), [r.label for r in got]


@pytest.mark.parametrize("block", [2048, 60])
def test_recall(spark, monkeypatch, vectors, block):
    monkeypatch.setattr(N, "BLOCK", block)
    v, _ = vectors
    scratch = Scratch(spark, "t")
    points = N.numbered_points(frame(spark, v), scratch)
    found = L.descend(points, 15, scratch)
    exact = N.neighbours(N.dealt(points, scratch), 15, scratch)
    want = {(i, int(j)) for i, own in enumerate(ranks(v)[:, :15]) for j in own}
    assert {(r.p, r.q) for r in exact.collect()} == want
    assert L.recall(found, exact).first().recall >= 0.9
    assert found.groupBy("p").count().where("count <> 15").count() == 0


def test_layout_takes_exact_lists(spark, monkeypatch, vectors):
    """In many blocks too, no neighbour is missed and no round of descent is run."""
    monkeypatch.setattr(N, "BLOCK", 60)
    v, lists, plain = vectors[0], [], L.fuzzy
    monkeypatch.setattr(L, "fuzzy", lambda graph, *a: lists.append(graph) or plain(graph, *a))
    assert L.umap(frame(spark, v), epochs=4, outer=1, scaled=False).count() == len(v)
    assert {(r.p, r.q) for r in lists[0].collect()} == {(i, int(j)) for i, own in enumerate(ranks(v)[:, :15]) for j in own}


@pytest.mark.parametrize("block", [2048, 150])
def test_layout_keeps_neighbours(spark, monkeypatch, vectors, block):
    monkeypatch.setattr(N, "BLOCK", block)
    v, _ = vectors
    z = (v - v.mean(0)) / v.std(0)
    df = frame(spark, v)
    got = {r.id: r.y for r in L.umap(df, outer=30).collect()}
    y = np.array([got[i] for i in range(len(v))])
    scratch = Scratch(spark, "t")
    flat = {r.p: r.y for r in L.principal(N.numbered_points(frame(spark, z), scratch), 2).collect()}
    flat = np.array([flat[i] for i in range(len(v))])
    u, s, _ = np.linalg.svd(z - z.mean(0), full_matrices=False)
    assert np.allclose(abs(np.corrcoef(flat[:, 0], u[:, 0] * s[0])[0, 1]), 1)
    assert trustworthiness(z, y) > trustworthiness(z, flat) + 0.02
    if block < 2048:
        return
    again = {r.id: r.y for r in L.umap(df.repartition(5)).collect()}
    assert all(np.allclose(got[i], again[i]) for i in got)


def test_weights(spark):
    scratch = Scratch(spark, "t")
    d = {0: [(1, 1.0), (2, 2.0), (3, 4.0)], 1: [(0, 1.0), (2, 1.5), (3, 3.0)], 2: [(0, 0.0), (1, 0.0), (3, 0.0)]}
    df = spark.createDataFrame([(p, q, x) for p, own in d.items() for q, x in own], "p long, q long, d double")
    got = {(r.p, r.q): r.w for r in L.fuzzy(df, 3, scratch).collect()}

    def one(own):
        positive = [x for _, x in own if x > 0]
        near, low, high = min(positive, default=0.0), 1e-9, 1e9
        for _ in range(200):
            mid = (low * high) ** 0.5
            low, high = (low, mid) if sum(np.exp(-max(x - near, 0) / mid) for _, x in own) > np.log2(3) else (mid, high)
        return {q: np.exp(-max(x - near, 0) / mid) for q, x in own}

    w = {p: one(own) for p, own in d.items()}
    for p, q in got:
        a, b = w.get(p, {}).get(q, 0), w.get(q, {}).get(p, 0)
        assert abs(got[p, q] - (a + b - a * b)) < 1e-6 and got[p, q] == got[q, p]
    assert (3, 0) in got and len(got) == 12


def test_curve_and_few_rows(spark):
    a, b = L.curve(0.1)
    assert abs(a - 1.577) < 0.01 and abs(b - 0.895) < 0.01  # the published values for 0.1
    assert L.umap(frame(spark, []).limit(0)).count() == 0
    assert L.umap(frame(spark, [[1.0, 2.0]])).count() == 1
    same = L.umap(frame(spark, [[1.0, 2.0]] * 6), epochs=12).collect()
    assert len(same) == 6 and all(np.isfinite(r.y).all() for r in same)

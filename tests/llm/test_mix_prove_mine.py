"""Operators 11 to 13 against plain Python on small tables with nulls, ties, repeated rows, hot groups and odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.llm import merkle, mixing, negatives
from fieldloom.llm.ranges import numbered

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, idx int, key string, part_ string"


def rows_of(n=700, seed=1):
    """A source and a language with most rows, copies, null and repeated ids, empty and null texts, one very long text."""
    r, out = random.Random(seed), []
    for i in range(n):
        text = " ".join(r.choice(["Alpha", "beta", "Gamma\t", "d\x0be", "é"]) for _ in range(int(r.lognormvariate(3, 1))))
        source = "hot" if r.random() < 0.4 else r.choice(["a", "B", "ü", "", None, "tiny"])
        lang = "en" if r.random() < 0.6 else r.choice(["de", "", None, "ü", *[f"l{k}" for k in range(20)]])
        out.append((i * 3, text, lang, source, len(text)))
    out += [(5, None, None, None, None), (5, "", "en", "hot", 0), (None, "A b C", "en", "hot", 5), (None, "A b C", "en", "hot", 5), (None, None, "de", "a", None)]
    out += [(9_000, "Copy of One", "en", "hot", 11)] * 40 + [(-7, "word " * 20_000, "de", "a", 100_000), (2**63 - 1, "End", "en", "B", 3), (-(2**63), "Start", "en", "B", 5)]
    return out


@pytest.fixture(scope="module")
def rows():
    return rows_of()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", "p") for r in rows], SCHEMA).repartition(7)


def test_places(spark):
    rows = [("hot", i % 3, i) for i in range(50)] + [("b", None, 7), ("b", 1, 8)] + [("hot", 1, 1)] * 20
    df = spark.createDataFrame(rows, "g string, k long, v long")
    got = numbered(df, "g", ["k"], "v", aim=9).collect()
    for g in ("hot", "b"):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.idx)
        assert [r.idx for r in own] == list(range(len(own))) and {r.n for r in own} == {len(own)}
        assert [r.k is not None and r.k for r in own] == sorted(r.k is not None and r.k for r in own)
        assert [r.upto for r in own] == np.cumsum([r.v for r in own]).tolist()
    assert numbered(df.limit(0), "g", ["k"]).count() == 0


# --- mixing ----------------------------------------------------------------------------------------------------------


def plain_mix(rows):
    size = lambda t: len(re.findall(mixing.WORD, t or ""))
    of = defaultdict(int)
    for _, t, _, s, _ in rows:
        of[s] += size(t)
    order = sorted(of, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(of), 1.5 * sum(of.values())
    while free:
        level = left / sum(weight[s] for s in free)
        above = {s for s in free if level * weight[s] > 2 * of[s]}
        for s in above or free:
            target[s] = 2 * of[s] if above else level * weight[s]
        left -= sum(2 * of[s] for s in above)
        free = free - above if above else set()
    return of, target, size


def test_mix(docs, rows):
    of, target, size = plain_mix(rows)
    got = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, *_ in rows)
    source = Counter()
    for i, t, _, s, _ in rows:
        source[i, size(t), of[s]] += 1
    assert Counter((r.doc_id, r["size"], r.source_size) for r in got) == source
    by = defaultdict(list)
    for r in got:
        by[r.source_size, round(r.target, 6)].append(r)
    assert set(by) == {(of[s], round(target[s], 6)) for s in of}
    for (_, t), own in by.items():
        assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in own)
        # closed to within the smallest document that is left
        untaken = [r["size"] for r in own if 0 < r["size"] and r.taken < 2 * r["size"]]
        assert abs(sum(r.taken for r in own) - t) <= min(untaken, default=1), t
    assert abs(sum(target.values()) - 1.5 * sum(of.values())) < 1e-6
    again = mixing.mix(docs.repartition(3)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_chances_follow_size(spark):
    """Over many seeds a document is taken as often as its chance says, and longer ones more often."""
    rows = [(i, "w " * (8 if i % 2 else 128), "s") for i in range(120)] + [(1000, "w " * 30_000, "other")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    taken = Counter()
    for seed in range(6):
        for r in mixing.mix(df, weights=(1, 1), share=0.1, seed=seed).where("doc_id < 1000").collect():
            taken[r["size"]] += r.taken > 0
    sizes = mixing.sized(df).withColumn("k", (F.length(F.bin("size")) - 1).cast("int"))
    chance = {r.k: r.chance + r.whole for r in mixing.shares(sizes, mixing.targets(sizes.groupBy("key").agg(F.sum("size").alias("source_size")), (1, 1), 0.1)).where("source_size < 20000").collect()}
    assert math.isclose(chance[7] / chance[3], 2, rel_tol=1e-2)
    for size, k in ((8, 3), (128, 7)):
        assert abs(taken[size] / 360 - chance[k]) < 0.12


def test_mix_of_nothing(spark, docs):
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = mixing.mix(spark.createDataFrame([(1, None, "a"), (None, " \t", None)], "doc_id long, text string, source string")).collect()
    assert [(r["size"], r.target, r.taken) for r in blank] == [(0, 0.0, 0)] * 2


# --- proofs ----------------------------------------------------------------------------------------------------------


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def grow(nodes):
    """Levels of a tree from its leaves."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
    return levels


def sides(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i // 8 * 8 : i // 8 * 8 + 8]
        out.append((run[: i % 8], run[i % 8 + 1 :]))
        i //= 8
    return out


def plain_proofs(rows):
    leaf = lambda i, t, g, s, n: h(*map(field, (i, s, g, n, t)))
    by = defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    by = {g: sorted(own, key=lambda x: x[:3]) for g, own in by.items()}
    trees = {g: (own, grow([x[2] for x in own])) for g, own in by.items()}
    order = sorted(trees, key=lambda g: (g is not None, (g or "").encode()))
    top = grow([trees[g][1][-1][0] for g in order])
    out = Counter()
    for k, g in enumerate(order):
        own, levels = trees[g]
        for i, (_, _, d, r) in enumerate(own):
            way = sides(levels, i) + sides(top, k)
            claim = d
            if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0:
                claim = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in way:
                claim = h(*left, claim, *right)
            out[r[0], d, levels[-1][0], top[-1][0], h(*[x for left, right in way for x in left + right]), claim, claim == top[-1][0]] += 1
    return out


def report(df):
    return Counter(map(tuple, merkle.manifest_report(df).collect()))


def test_proofs(docs, rows):
    want = plain_proofs(rows)
    assert report(docs) == want
    assert {k[-1] for k in want} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_proofs_of_few(spark, n):
    rows = [(i, f"T{i}", "x", None, 2) for i in range(n)]
    assert report(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")) == plain_proofs(rows)


def test_proofs_of_nothing(docs):
    assert merkle.manifest_report(docs.limit(0)).count() == 0


# --- hard negatives --------------------------------------------------------------------------------------------------


def plain_mine(rows):
    sound = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows if None not in (i, v, label) and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for p, (a, la, va) in enumerate(sound):
        if a % 100:
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, v)), i, lb) for q, (i, lb, v) in enumerate(sound) if q != p and len(v) == len(va))
        for s, i, _ in [x for x in scores if x[2] == la][:5]:
            window = [(t, j) for t, j, lb in scores if lb != la and 80 * -s <= 100 * -t <= 100 * -s]
            for rank, (t, j) in enumerate(window[:5], 1):
                out[a, i, rank, j, -s, -t] += 1
    return out


def vectors(seed=3, n=900, dim=12):
    r = np.random.default_rng(seed)
    centers = r.normal(size=(4, dim))
    rows = [(int(i), [float(x) for x in np.float32(centers[i % 4] + 0.7 * r.normal(size=dim))], int(r.integers(0, 3)) if i % 3 else 1) for i in range(n)]
    same = rows[50][1]
    rows += [(10_000 + i, same, i % 3) for i in range(60)]  # ties
    rows += [rows[100], rows[100], rows[101], (-200, rows[5][1], 1), (-100, [-x for x in rows[0][1]], 7)]
    rows += [(None, same, 1), (7, None, 1), (8, [None] * dim, 1), (9, [float("nan")] * dim, 2), (11, [float("inf")] * dim, 2), (12, same, None)]
    rows += [(300, [1.0, 2.0], 0), (13, [1.0, 1.9], 0), (15, [0.9, 1.9], 4), (400, [], 0), (16, [], 0), (17, [], 3)]
    return rows


def mined(df):
    return Counter(map(tuple, negatives.mine(df, F.col("vec_id") % 100 == 0, negatives.shifted_label()).collect()))


@pytest.mark.parametrize(("block", "chunk"), [(8192, 4096), (40, 3)])
def test_mine(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "CHUNK", chunk)
    rows = vectors()
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, label int, idx int, dim int")
    want = plain_mine(rows)
    assert mined(df) == want and len(want) > 50


def test_mine_few(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert not mined(spark.createDataFrame([], schema)) and not mined(spark.createDataFrame([(0, [1.0], 1)], schema))
    far = [(100, [3e38, -3e38], 0), (1, [3e38, -3e38], 0), (2, [3e38, -3e38], 1)]  # cut, no overflow
    assert [k[:4] for k in mined(spark.createDataFrame(far, schema))] == [(100, 1, 1, 2)]


def test_tree_prunes():
    """Balls bound scores from both sides; on clustered rows most pairs are never scored."""
    r = np.random.default_rng(5)
    centers = r.normal(size=(40, 16)) * 60
    x = np.floor(centers[r.integers(0, 40, 6000)] + r.normal(size=(6000, 16)) * 6).astype(np.int64)
    q, ids, labels = x[::200], np.arange(6000), np.arange(6000) % 7
    own = np.arange(0, 6000, 200)
    full = q @ x.T
    for low, high in ((-(2**62), 2**62), (20_000, 30_000)):
        seen = []
        n = len(q)
        best = negatives.search(x, ids, ids, labels, q, np.arange(n), own, labels[own], np.full(n, low), np.full(n, high), False, 5, seen)
        for i in range(n):
            want = sorted((-s, j) for j, s in enumerate(full[i].tolist()) if low <= s <= high and labels[j] != labels[own[i]])[:5]
            assert [(-best.score[i, p], best.id[i, p]) for p in range(best.n[i])] == want
        assert sum(seen) < 0.6 * full.size

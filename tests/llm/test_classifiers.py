from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from fieldloom.llm import linear, quality, toxicity


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(2)
    plain = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8))) for _ in range(300)]
    rude = ["blorg", "snarfle", "grumph", "vexwort", "dregling"]
    docs, labels = [], []
    for i in range(700):
        w = [r.choice(plain) for _ in range(r.randint(20, 90))]
        toxic, good = i % 6 == 0, i % 5 != 0
        if toxic:
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(rude)
        if not good:
            w = [x + r.choice(["###", "%%%", "!!"]) for x in w]
        docs.append((i, " ".join(w), "x", 0.5))
        labels.append((i, int(good), int(toxic)))
    docs += [(1000, None, "x", 0.1), (1001, "", "x", 0.1), (1001, "", "x", 0.1), (1002, "word " * 40_000, "x", 0.2)]
    docs += [(1003, "", "x", 0.1), (1004, None, "x", 0.1), (1006, "!!", "x", 0.1)]
    labels += [(None, 1, 0), (1001, None, None), (5000, 1, 1), (1003, 0, 0), (1004, 0, 0), (1006, 0, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {a: (b, c) for a, b, c in labels}


@pytest.mark.parametrize(("op", "at", "threshold"), [(quality, 0, 0.7), (toxicity, 1, 0.3)])
def test_held_out(tables, op, at, threshold):
    docs, labels, truth = tables
    got = op.score(docs, op.fit(docs, labels)).collect()
    assert len(got) == docs.count() and {f for f in got[0].asDict()} == {"doc_id", "held_out", "score", "predicted"}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in got)
    right = np.mean([r.predicted == truth[r.doc_id][at] for r in held])
    assert right > 0.93, right


def test_one_class_and_empty(spark, tables):
    docs, labels, _ = tables
    for op in (quality, toxicity):
        model = op.fit(docs, labels.limit(0))
        assert {round(r.score, 6) for r in op.score(docs, model).collect()} == {0.5}
        assert op.score(docs.limit(0), model).count() == 0


def test_keep_passes_columns(tables):
    docs, labels, truth = tables
    model = quality.fit(docs, labels)
    kept = quality.keep(docs, model)
    assert kept.columns == docs.columns
    want = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    assert {r.doc_id for r in kept.collect()} == want


def test_hinge_separates():
    rng = np.random.default_rng(0)
    rows = [(np.array([0, 1]), np.array([x, y])) for x, y in rng.normal(size=(200, 2))]
    x = linear.Rows(rows)
    y = np.where(x.val[0::2] + x.val[1::2] > 0, 1.0, -1.0)
    w, b = linear.hinge_dual(x, y, 2, np.full(200, 1.0))
    assert np.mean(np.sign(x.dot(w) + b) == y) > 0.95


def test_hinge_is_linear():
    """Dual variables end at their bounds or where the margin is one, and the primal and dual objectives meet."""
    rng = np.random.default_rng(4)
    a = rng.normal(size=(60, 5))
    y = np.where(a @ rng.normal(size=5) + rng.normal(size=60) > 0, 1.0, -1.0)
    c = rng.uniform(0.2, 2, 60)
    w, b = linear.hinge_dual(linear.Rows([(np.arange(5), r) for r in a]), y, 5, c, epochs=3000)
    full = np.append(w, b)
    z = np.hstack([a, np.ones((60, 1))])
    value = full @ full / 2 + c @ np.maximum(0, 1 - y * (z @ full))
    for _ in range(200):  # no direction goes down
        assert full_value(full + rng.normal(size=6) * 1e-3, z, y, c) >= value - 1e-6


def full_value(w, z, y, c):
    return w @ w / 2 + c @ np.maximum(0, 1 - y * (z @ w))


def test_label_model_finds_good_voters():
    rng = np.random.default_rng(1)
    truth = rng.random(2000) < 0.3
    votes = np.stack([np.where(rng.random(2000) < p, np.where(truth, 1, -1), np.where(truth, -1, 1)) for p in (0.95, 0.9, 0.85, 0.6)], axis=1)
    post, accuracy, _, _ = toxicity.label_model(votes, 0.3)
    assert np.mean((post > 0.5) == truth) > 0.95 and accuracy[0] > accuracy[3]
    twice = np.concatenate([votes, votes[:, 3:], votes[:, 3:]], axis=1)  # a copied weak voter hangs on itself and adds nothing
    again, _, parent, strength = toxicity.label_model(twice, 0.3)
    assert {frozenset((k, int(parent[k]))) for k in range(6)} >= {frozenset((3, 4))} or {frozenset((k, int(parent[k]))) for k in range(6)} >= {frozenset((3, 5)), frozenset((4, 5))}
    assert np.abs(again - post).max() < 0.15 and np.mean((again > 0.5) == (post > 0.5)) > 0.99


def test_label_model_recovers_an_exact_one():
    """Votes drawn from a known tree of correlated voters: the posterior is near that of the true parameters, and nearer than without correlations."""
    rng = np.random.default_rng(2)
    n = 20_000
    truth = rng.random(n) < 0.25
    first = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])  # by class: -1, 0, 1
    others = [np.array([[[0.8, 0.15, 0.05], [0.3, 0.5, 0.2], [0.1, 0.2, 0.7]], [[0.5, 0.3, 0.2], [0.1, 0.5, 0.4], [0.05, 0.1, 0.85]]]), np.array([[[0.7, 0.2, 0.1]] * 3, [[0.15, 0.25, 0.6]] * 3])]
    hangs = [0, 0, 1, 0]  # of voters 1 to 4; 1 and 3 depend on it, 2 and 4 don't
    tables = [others[0], others[1], others[0], others[1]]
    draw = lambda p: (rng.random(len(p))[:, None] > np.cumsum(p, axis=1)).sum(axis=1)
    at, c = [draw(first[truth.astype(int)])], truth.astype(int)
    ratio = np.log(first[1][at[0]] / first[0][at[0]])
    for k, t in enumerate(tables):
        at.append(draw(t[c, at[hangs[k]]]))
        ratio += np.log(t[1, at[hangs[k]], at[-1]] / t[0, at[hangs[k]], at[-1]])
    exact = 1 / (1 + np.exp(-(ratio + np.log(0.25 / 0.75))))
    votes = np.stack(at, axis=1) - 1
    post, _, parent, strength = toxicity.label_model(votes, 0.25)
    edges = {frozenset((k, int(parent[k]))) for k in range(5) if parent[k] >= 0 and strength[k] > 0.02}
    assert edges == {frozenset((0, 1)), frozenset((1, 3))}
    alone = toxicity.pair_tables(votes, exact)
    plain = toxicity.evidence(votes, np.full(5, -1), toxicity.log_ratios(alone, np.full(5, -1)))
    plain = 1 / (1 + np.exp(-(plain + np.log(0.25 / 0.75))))
    assert np.abs(post - exact).mean() < 0.5 * np.abs(plain - exact).mean() and np.abs(post - exact).mean() < 0.05


def grams(text):
    """The quality features of a text, as strings."""
    raw, words = text.encode(), text.split()
    out = {("b", raw[i : i + n]) for n in (3, 5) for i in range(len(raw) - n + 1)} | {("w", w) for w in words} | {("p", a, b) for a, b in zip(words, words[1:])}
    return out | ({"loops"} if len(words) > 1 and np.mean([a == b for a, b in zip(words, words[1:])]) > 0.05 else set())


def test_quality_is_a_dense_machine(spark):
    """Scores against exact features, dense matrices and a plain descent on the machine's objective."""
    r = random.Random(6)
    good, bad = ["moss", "fern", "birch", "stone", "river", "cloud"], ["zzq", "xkcd", "qqq", "vvv", "stone", "cloud"]
    docs, labels = [], []
    for i in range(240):
        y = i % 2
        docs.append((i, " ".join(r.choice(good if y or r.random() < 0.2 else bad) for _ in range(r.randint(4, 12)))))
        labels.append((i, y))
    docs_df, labels_df = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    got = {x.doc_id: x.score for x in quality.score(docs_df, quality.fit(docs_df, labels_df)).collect()}

    learnt = [i for i, _ in docs if zlib.crc32(str(i).encode()) % 4 != 2]
    top = 1 << 64
    apart = {i for i in learnt if (i * 0x9E3779B97F4A7C15 % top >> 40) % 5 == 0}
    names = {g: k for k, g in enumerate(sorted({g for _, t in docs for g in grams(t)}, key=str))}
    x = np.zeros((len(docs), len(names)))
    for i, t in docs:
        x[i, [names[g] for g in grams(t)]] = 1
    y = np.array([c for _, c in labels])
    own = np.array([i for i in learnt if i not in apart])
    p, q = x[own][y[own] == 1].sum(axis=0), x[own][y[own] == 0].sum(axis=0)
    seen = p + q >= 2
    # the hashed table has room for all cells, seen or not
    cells = 1 << quality.BITS
    ratio = np.where(seen, np.log((p + 1) / (p.sum() + cells)) - np.log((q + 1) / (q.sum() + cells)), 0)
    z = x * ratio
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    a, s = np.hstack([z[own], np.ones((len(own), 1))]), np.where(y[own] == 1, 1.0, -1.0)
    c = np.where(s > 0, len(own) / (2 * (s > 0).sum()), len(own) / (2 * (s < 0).sum()))
    # half |w|^2 + sum c max(0, 1 - s a w), by projected gradients of its dual
    own_q = (a * s[:, None]) @ (a * s[:, None]).T
    dual, step = np.zeros(len(a)), 1 / np.linalg.eigvalsh(own_q)[-1]
    for _ in range(60_000):
        dual = np.clip(dual - step * (own_q @ dual - 1), 0, c)
    w = a.T @ (s * dual)
    loss = lambda w: w @ w / 2 + c @ np.maximum(0, 1 - s * (a @ w))
    assert loss(w) - (dual.sum() - dual @ own_q @ dual / 2) < 1e-4  # no gap left: the optimum
    margin = np.hstack([z, np.ones((len(docs), 1))]) @ w
    rest = np.array(sorted(apart))
    slope, offset = linear.platt(margin[rest], y[rest].astype(float))
    want = 1 / (1 + np.exp(-(slope * margin + offset)))
    assert max(abs(got[i] - want[i]) for i, _ in docs) < 0.02


def test_label_model_is_plain_em():
    """The posterior against expectation maximisation written out vote by vote."""
    rng = np.random.default_rng(4)
    truth = rng.random(150) < 0.3
    votes = np.stack([np.where(rng.random(150) < 0.2, 0, np.where(rng.random(150) < p, np.where(truth, 1, -1), np.where(truth, -1, 1))) for p in (0.9, 0.8, 0.7)], axis=1)
    votes = np.concatenate([votes, votes[:, 2:]], axis=1)
    got, _, _, _ = toxicity.label_model(votes, 0.3, rounds=7)
    m, values = votes.shape[1], (-1, 0, 1)
    alike = np.abs(np.corrcoef(votes.T))
    voice = [1 / sum(c for c in row if c > 0.5) for row in alike]
    said = [sum(w for v, w in zip(r, voice) if v > 0) for r in votes]
    post = [0.9 if s > max(np.quantile(said, 0.7), 0.01) else 0.02 for s in said]
    for step in range(7):
        mass = lambda cls: [p if cls else 1 - p for p in post]
        pair = {(cls, j, a, k, b): sum(w for w, r in zip(mass(cls), votes) if r[j] == a and r[k] == b) for cls in (0, 1) for j in range(m) for k in range(m) for a in values for b in values}
        own = {}
        for cls in (0, 1):
            for k in range(m):
                n = {a: 0.5 + pair[cls, k, a, k, a] for a in values}
                own[cls, k] = {a: n[a] / sum(n.values()) for a in values}
        if step % 5 == 0:
            parent, _ = toxicity.dependence_tree(toxicity.pair_tables(votes, np.array(post)))
        new = []
        for r in votes:
            odds = np.log(0.3 / 0.7)
            for k in range(m):
                j = parent[k]
                if j < 0:
                    odds += np.log(own[1, k][r[k]] / own[0, k][r[k]])
                    continue
                share = []
                for cls in (0, 1):
                    given = {b: pair[cls, j, r[j], k, b] + toxicity.PULL * own[cls, k][b] for b in values}
                    share.append(given[r[k]] / sum(given.values()))
                odds += np.log(share[1] / share[0])
            new.append(1 / (1 + np.exp(-odds)))
        done = max(abs(a - b) for a, b in zip(new, post)) < 1e-4
        post = new
        if done:
            break
    assert np.abs(got - np.array(post)).max() < 1e-6


def test_own_lexicons():
    """Each word once in its language, lower case, as the words of texts are cut."""
    for name, words in toxicity.OWN_LEXICONS.items():
        own = words.split()
        assert len(set(own)) == len(own) and all(toxicity.distinct_words(w) == {w} for w in own), name

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from fieldloom.llm import components, jaccard, lines, wordhash


def words(r, n):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, k, num, den):
    s = [(i, shingles(t, k)) for i, t in docs]
    best = {i: i for i, _ in docs}
    edges = [(a, b) for x, (a, p) in enumerate(s) for b, q in s[:x] if p and q and den * len(p & q) >= num * len(p | q)]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(best[a], best[b])
            if best[a] != m or best[b] != m:
                best[a] = best[b] = m
                changed = True
    return best


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(5)
    docs, base = [], [words(r, 60 + 5 * i) for i in range(12)]
    for b in base:
        for _ in range(6):
            w = b.split()
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5])):
                w[r.randrange(len(w))] = words(r, 1)
            docs.append(" ".join(w))
    chain = words(r, 80).split()  # each links to the one before, the ends not to each other
    for _ in range(15):
        chain = chain[1:] + [words(r, 1)]
        docs.append(" ".join(chain))
    shared = words(r, 40)
    docs += [f"{words(r, 30)} {shared} {words(r, 30)}" for _ in range(20)]
    docs += [None, "", "  \n ", "one", "ONE", "one two", "one two", "a b c", "A b\tc", "É b c", "é b c"]
    r.shuffle(docs)
    return [(10 * i + 3, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 80, 100)])
def test_jaccard_is_brute_force(spark, corpus, k, num, den):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in corpus], "doc_id long, text string, n string, component_id int")
    got = {r.doc_id: r for r in jaccard.linked(df, k, num, den).collect()}
    want = brute(corpus, k, num, den)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(got[i].n_shingles == len(shingles(t, k)) for i, t in corpus)


def test_jaccard_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.linked(empty).count() == 0
    same = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (2, "a b c d e f"), (9, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.component_id) for r in jaccard.linked(same).collect()) == [(2, 2), (4, 2), (4, 2), (9, 9)]


def test_jaccard_long_lists(spark, monkeypatch):
    """A shingle in a third of the texts, lists in several parts, and ids in no order."""
    monkeypatch.setattr(jaccard, "PART", 5)
    r = random.Random(9)
    common = words(r, 6)
    base = [words(r, 12) for _ in range(3)]
    docs = [f"{common} {words(r, 4)}" for _ in range(40)] + [common] * 5 + [f"{common} {words(r, 1)}" for _ in range(30)]
    docs += [f"{r.choice(base)} {words(r, 1)}" for _ in range(60)] + [words(r, 20) for _ in range(30)]
    docs = [(r.randrange(-(1 << 62), 1 << 62), t) for t in docs]
    for k, num, den in ((3, 90, 100), (5, 80, 100), (3, 50, 100)):
        got = {x.doc_id: x.component_id for x in jaccard.linked(spark.createDataFrame(docs, "doc_id long, text string"), k, num, den).collect()}
        assert got == brute(docs, k, num, den)


def test_one_of_each(spark):
    t, u, v = "a b c d e f", "q r s t u v", "k l m n o p"
    rows = [(1, t), (2, t), (2, u), (5, v), (5, v), (None, t), (None, "x y z"), (None, "x y z"), (7, None), (8, ""), (8, "")]
    df = spark.createDataFrame([(i, x, 1, 2, "z") for i, x in rows], "doc_id long, text string, key_1 int, hit int, place string")
    got = jaccard.one_of_each(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id or 0, r.text or "") for r in got.collect())) == [(0, "x y z"), (0, "x y z"), (1, t), (2, u), (5, v), (7, ""), (8, ""), (8, "")]
    assert jaccard.one_of_each(df.limit(0)).count() == 0


def test_components(spark):
    e = [(i, i + 1) for i in range(30)] + [(50, 51), (51, 50), (60, 60)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 31)}, 51: 50}


@pytest.fixture(scope="module")
def lined():
    r = random.Random(9)
    sentence = lambda: words(r, r.randint(5, 12)) + "."
    passage = " ".join(sentence() for _ in range(14))
    docs = []
    for i in range(24):
        parts = [sentence() for _ in range(8)]
        if i % 3 == 0:
            parts.insert(r.randrange(9), passage)
        docs.append((i, "\n".join(parts)))
    docs += [(100, docs[1][1]), (101, None), (102, ""), (103, "one line only"), (104, "one line only")]
    return docs, passage


def test_line_dedup_is_brute_force(spark, lined):
    docs, passage = lined
    df = spark.createDataFrame([(i, t, 7) for i, t in docs], "doc_id long, text string, chunks int")
    got = {r.doc_id: r for r in lines.dedup(df).collect()}
    want = dict(zip((i for i, _ in docs), lines.brute_force(docs)))
    assert {i: r.text for i, r in got.items()} == want
    assert passage in want[0]
    left = [len(want[i]) / len(dict(docs)[i]) for i in range(3, 24, 3)]
    assert sum(left) / len(left) < 0.7 and max(left) < 0.95  # most of the passage goes from every later document
    assert all(want[i] == dict(docs)[i] for i in range(24) if i % 3)  # clean documents are left alone
    assert want[100] == "" and got[103].text == "one line only"


def test_line_dedup_documents(spark, lined):
    docs, _ = lined
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in docs], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in lines.dedup_documents(df).collect()}
    assert 100 not in got and got[101].text is None and got[102].text == ""
    assert all(r.n_chars == len(r.text or "") for r in got.values())
    assert lines.dedup_documents(df.limit(0)).count() == 0


def naive_chunks(text):
    """The chunk rule said plainly: lines by a pattern, hashes as sums of powers in Python integers."""
    top = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 29) * 0xBF58476D1CE4E5B9 & top
        return x ^ x >> 32

    def value(raw):
        return mix(sum(int(wordhash.VALUES[c]) * pow(0x9E3779B97F4A7C15, i, 1 << 64) for i, c in enumerate(raw)) & top)

    raw, at, found = text.encode(), 0, []
    for m in re.finditer(rb"[^\n]*?(?:\n|[.!?] |\Z)", raw, re.S):
        body = m.group().strip(b"\t\n\x0b\x0c\r ")
        if body:
            begin = m.start() + m.group().index(body)
            found.append((begin, begin + len(body), len(body.split())))
    out, at, before = [], 0, 0
    for k, (b, e, _) in enumerate(found, 1):
        h = value(raw[b:e])
        border = mix(before * 0x9E3779B97F4A7C15 + h & top) % 2 == 0
        before = h
        if k - at >= 2 and (border or k - at >= 24 or k == len(found)):
            if sum(x[2] for x in found[at:k]) >= 10:
                out.append((found[at][0], e))
            at = k
    return out


def test_lines_and_chunks():
    r = random.Random(3)
    piece = lambda: r.choice(["a", "é", "bc", "x y", ".", "! ", ". ", "?", "\n", "\n\n", " ", "\t", "\r\n", "some more words here", "ü.\n", "\x1c", "\xa0"])
    texts = ["".join(piece() for _ in range(r.randint(0, 120))) for _ in range(300)] + ["", "\n", " . ", "w " * 50, "same line here\n" * 100]
    scan = lines.Scan([t.encode() for t in texts])
    got = {}
    for w, b, e in zip(*(x.tolist() for x in scan.places(*scan.chunks()))):
        got.setdefault(w, []).append((b, e))
    assert [got.get(i, []) for i in range(len(texts))] == [naive_chunks(t) for t in texts]
    assert len(got) > 150
    many = [f"this is line {i}\n" for i in range(100)]
    a, b = lines.chunk_places("".join(many).encode()), lines.chunk_places(b"new\n" + "".join(many).encode())
    assert [(x - 4, y - 4) for x, y in b][-15:] == a[-15:]  # borders resist a shift


def test_line_dedup_clashing_columns(spark):
    docs = [(1, "one two three four five. six seven eight nine ten eleven.", "a"), (2, "one two three four five. six seven eight nine ten eleven.", "b")]
    df = spark.createDataFrame([(*d, 1, 2, 3, 4) for d in docs], "doc_id long, text string, drop_id string, drop_found int, found int, id int, `_drop_id` int")
    got = lines.dedup_documents(df).collect()
    assert [(r.doc_id, r.drop_id, r.drop_found, r.found, r.id) for r in got] == [(1, "a", 1, 2, 3)]


def test_line_dedup_of_any_ids(spark):
    """Null, repeated and extreme ids, equal rows in number, and texts that run into themselves."""
    from collections import Counter

    r = random.Random(5)
    long, other, short = words(r, 90), words(r, 70), "\n".join(words(r, 7) + "." for _ in range(5))
    low, high = -(1 << 63), (1 << 63) - 1
    docs = [(None, long), (None, long), (None, long), (None, other), (1, long), (low, short), (low, f"{other} {words(r, 9)}"), (high, short), (high, short), (0, f"{words(r, 30)} {other}")]
    docs += [(7, short), (7, f"{short}\n{words(r, 5)}"), (7, None), (None, None), (None, ""), (3, " \n "), (3, " \n "), (4, f"\n{long} {long}"), (4, f"\n{long} {long}"), (5, "same few words"), (5, "same few words")]
    docs += [(None, other)] * 40
    df = spark.createDataFrame([(*d, len(d[1] or ""), 1, "x") for d in docs], "doc_id long, text string, n_chars long, key int, again string").repartition(5)
    want = lines.brute_force(docs)
    assert Counter((x.doc_id, x.text) for x in lines.dedup(df).collect()) == Counter(zip((i for i, _ in docs), want))
    whole = lines.dedup_documents(df).collect()
    assert Counter((x.doc_id, x.text or "") for x in whole) == Counter((i, t) for (i, was), t in zip(docs, want) if t.strip() or t == (was or ""))
    assert whole[0].key == 1 and whole[0].again == "x" and all(x.n_chars == len(x.text or "") for x in whole)
    assert sum(t == long for t in want) == 1 and sum(t == other for t in want) == 1 and sum(t == short for t in want) == 1


def planted(r, n, stops):
    """A passage of n words, twice among other words of longer documents, mid-line."""
    end = (lambda: r.choice(["", "", "", "", "."])) if stops else (lambda: "")
    text = lambda n: " ".join(words(r, 1) + end() for _ in range(n))
    passage = text(n)
    return passage, [f"{text(r.randint(3, 90))} {passage} {text(r.randint(3, 90))}\n{text(20)}" for _ in range(2)]


def test_passages_inside_other_text_go_whole(spark):
    r = random.Random(11)
    docs, passages = [], []
    for k in range(60):
        passage, two = planted(r, r.choice([50, 51, 80, 200]), True)
        passages.append(passage)
        docs += [(2 * k, two[0]), (2 * k + 1, two[1])]
    passage, two = planted(r, 60, True)
    twice = f"{two[0]} {passage}"
    docs += [(900, twice), (901, " ".join(["spam"] * 300)), (902, None), (903, "é " * 20 + words(r, 60)), (904, "ü " * 31 + words(r, 20))]
    docs += [(904, docs[-1][1]), (None, docs[-2][1])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for x in lines.dedup(df).collect():
        got.setdefault(x.doc_id, []).append(x)
    for k, passage in enumerate(passages):
        before, after = docs[2 * k + 1][1].split(passage + " ")
        assert got[2 * k][0].text == docs[2 * k][1] and got[2 * k + 1][0].text == before + after
    assert got[900][0].text == two[0] + " " and got[901][0].text == " ".join(["spam"] * 50) + " "
    assert sorted(x.text for x in got[904]) == ["", docs[-3][1]]  # of equal rows one keeps its text
    assert got[None][0].text == docs[-1][1] and got[903][0].text == ""  # the null id comes first


@pytest.mark.parametrize("n", [51, 120])
def test_passages_without_stops_go_whole(spark, n):
    r = random.Random(n)
    passage, two = planted(r, n, False)
    row = "|".join(words(r, 1) for _ in range(3))
    table = " ".join(f"{row} {words(r, 1)}" for _ in range(n))
    docs = [(0, two[0]), (1, two[1]), (2, f"{words(r, 9)}\n{table}\n{words(r, 9)}"), (3, f"{words(r, 5)}\n{table}\n{words(r, 7)}"), (4, passage), (5, words(r, n))]
    got = {x.doc_id: x.text for x in lines.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert [got[i] for i in (0, 2, 5)] == [docs[i][1] for i in (0, 2, 5)]
    assert got[1] == docs[1][1].replace(passage + " ", "") and got[3] == docs[3][1].replace(table + "\n", "") and got[4] == ""


def test_bitmaps_bound_the_difference():
    """Of any two sets, whatever their sizes, no more cells differ than shingles do; and long sets are told apart."""
    r = np.random.default_rng(3)
    draw = lambda n: np.unique(r.integers(0, 1 << 64, n, np.uint64))
    sets = [draw(n) for n in (0, 1, 5, 1023, 1024, 1025, 3000, 9000, 20000)]
    sets += [np.union1d(sets[-1][: len(sets[-1]) // 2], draw(10000)), sets[-1][:-700]]
    for x in sets:
        assert jaccard.apart(jaccard.bitmap(x), jaccard.bitmap(x)) == 0
        for y in sets:
            assert jaccard.apart(jaccard.bitmap(x), jaccard.bitmap(y)) <= len(np.setxor1d(x, y))
    x, y = sets[8], sets[9]  # half alike: the bitmap alone rules out a link at 0.9
    differ = jaccard.apart(jaccard.bitmap(x), jaccard.bitmap(y))
    assert 100 * (len(x) + len(y) - differ) < 90 * (len(x) + len(y) + differ)


def test_jaccard_long_texts(spark):
    """Texts of more shingles than the least bitmap has cells, of sizes on both sides of a doubling."""
    r = random.Random(21)
    base = words(r, 2080).split()
    docs = [(1, " ".join(base))]
    for i, (cut, changed) in enumerate(((0, 3), (40, 2), (90, 0), (160, 0), (230, 0), (0, 60), (0, 200))):
        w = base[cut:]
        for _ in range(changed):
            w[r.randrange(len(w))] = words(r, 1)
        docs.append((i + 2, " ".join(w)))
    for k, num, den in ((3, 90, 100), (5, 80, 100), (3, 100, 100)):
        got = {x.doc_id: x.component_id for x in jaccard.linked(spark.createDataFrame(docs, "doc_id long, text string"), k, num, den).collect()}
        assert got == brute(docs, k, num, den)

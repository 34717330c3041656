"""The pipeline on a small corpus, against the same stages by brute force."""

from __future__ import annotations

import random
import struct
import zlib

import pytest

import corpus_pipeline
from fieldloom.llm import lines, quality, queries
from fieldloom.llm.common import read_table


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(zip(*[w[i:] for i in range(k)])) if len(w) >= k else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    r = random.Random(4)
    vocabulary = ["".join(r.choice("aeioulnrst") for _ in range(r.randint(3, 8))) for _ in range(400)]
    text = lambda n: " ".join(r.choice(vocabulary) + r.choice(["", "", "", "", "."]) for _ in range(n))
    docs, labels = [], []
    for i in range(160):
        t = text(r.randint(40, 120))
        good = i % 4 != 0
        docs.append((i, t if good else " ".join(w + "%%%" for w in t.split()), "en", "s"))
        labels.append((i, int(good), 0))
    for k in range(10):
        w = docs[4 * k + 1][1].split()
        w[5] = "edited"
        docs.append((200 + k, " ".join(w), "en", "s"))
    docs += [(300, docs[2][1], "en", "s"), (301, None, "en", "s"), (302, text(30) + ' token = "0123456789abcdef0123456789abcdef"', "en", "s")]
    root = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    return root


def test_stages_by_brute_force(spark, small):
    docs = read_table(spark, small, "documents")
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "n-gram jaccard join", "secret scans", "packing"]
    one = stages["quality classifier"](spark, docs, small).cache()
    model = quality.fit(docs, read_table(spark, small, "labels"))
    assert {r.doc_id for r in one.collect()} == {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    bad = {i for i in range(0, 160, 4)}
    assert not bad & {r.doc_id for r in one.collect()}

    two = stages["line dedup"](spark, one, small).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    want = dict(zip((i for i, _ in rows), lines.brute_force(rows)))
    before = {r.doc_id: r.text for r in one.collect()}
    assert {r.doc_id: r.text or "" for r in two.collect()} == {i: t for i, t in want.items() if t.strip() or not before[i]}

    three = stages["n-gram jaccard join"](spark, two, small).cache()
    s = {r.doc_id: shingles(r.text, 5) for r in two.collect()}
    best = {i: i for i in s}
    for _ in s:
        for a in s:
            for b in s:
                if a < b and s[a] and s[b] and 10 * len(s[a] & s[b]) >= 8 * len(s[a] | s[b]):
                    best[a] = best[b] = min(best[a], best[b])
        if all(best[best[i]] == best[i] for i in s):
            break
    assert {r.doc_id for r in three.collect()} == {i for i in s if best[i] == i}

    four = {r.doc_id: r for r in stages["secret scans"](spark, three, small).collect()}
    texts = {r.doc_id: r.text for r in three.collect()}
    assert set(four) == set(texts) and all(r.text == texts[i] for i, r in four.items() if i != 302)
    assert 302 in texts and four[302].text.endswith('[assign]"') and four[302].n_chars == len(four[302].text)


    # packing: the library's own ids of each text, and sequences without gaps
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(queries.tokenizer_path("word_bpe_49k.json"))
    ids = {i: [*own.encode(r.text or "", add_special_tokens=False).ids, 1] for i, r in four.items()}
    pieces = stages["packing"](spark, spark.createDataFrame(list(four.values()), three.schema), small).collect()
    at, sequences = {}, {}
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0) and r.doc_tokens == len(ids[r.doc_id])
        at[r.doc_id] = r.start + r.length
        assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[r.doc_id][r.start : r.start + r.length]))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in ids.items()}
    for found in sequences.values():
        end = 0
        for offset, length in sorted(found):
            assert offset == end
            end += length
        assert end == 2048 or end & (end - 1) == 0


def test_run(spark, small):
    got = corpus_pipeline.run(spark, small).toPandas()
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and len(got) > 50
    assert (got.groupby("doc_id").length.sum() == got.groupby("doc_id").doc_tokens.first()).all()

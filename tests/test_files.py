"""Annotation reader and payload writer as data sources, converters by name."""

from __future__ import annotations

import io
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import codecs
from fieldloom.operators import catalog as C
from fieldloom.plans import session as N
from fieldloom.sources import converters as V
from fieldloom.sources import files as S
from fieldloom.sources import sinks as K


def test_lines_of_every_split():
    text = b"one\n\ntwo is longer\n\xc3\xa9\nlast without an end"
    want = [(0, b"one"), (5, b"two is longer"), (19, b"\xc3\xa9"), (22, b"last without an end")]
    for step in range(1, len(text) + 3):
        got = [x for a in range(0, len(text), step) for x in S.lines_from(io.BytesIO(text), a, min(a + step, len(text)))]
        assert got == want, step
    assert list(S.lines_from(io.BytesIO(b""), 0, 0)) == []


@pytest.fixture
def lines(tmp_path):
    items = [{"stem": i, "leaves": {"kind": "é", "n": i, "tags": [1, "b"]}, "objects": [{"class_id": "c", "bbox": [1, 2, 3, 4]}, {"rle": {"size": [2, 2], "counts": [1, 3]}}] if i % 2 else []} for i in range(40)]
    folder = tmp_path / "lines"
    (folder / "deep").mkdir(parents=True)
    for name, own in (("a.jsonl", items[:25]), ("deep/b.jsonl", items[25:])):
        (folder / name).write_text("\n".join(json.dumps(i, ensure_ascii=False) for i in own))
    (folder / "_ignored.jsonl").write_text("no json")
    (folder / "empty.jsonl").write_text("")
    return folder


def test_annotation_reader(spark, lines):
    S.register(spark)
    want = {(str(i), k, v) for i in range(40) for k, v in (("kind", '"\\u00e9"'), ("n", str(i)), ("tags", '[1,"b"]'))}
    for split in (50, 10_000):
        df = spark.read.format("fieldloom_lines").option("split", split).load(str(lines))
        rows = df.collect()
        assert {(r.stem, r.name, r.value) for r in rows if not r.path} == want and {r.category for r in rows} == {"modified"}
        boxes = [r for r in rows if r.name == "bbox"]
        assert len(boxes) == 20 and all(r.path == ["0"] and json.loads(r.value) == {"x0": 1, "y0": 2, "x1": 3, "y1": 4} for r in boxes)
        assert {(r.type, r.format) for r in rows if r.name == "rle"} == {("rle", "")} and len(rows) == 120 + 60
        assert df.rdd.getNumPartitions() == sum(-(-os.path.getsize(lines / p) // split) for p in ("a.jsonl", "deep/b.jsonl"))
    assert spark.read.format("fieldloom_lines").load(f"file://{lines}/a.jsonl").select("stem").distinct().count() == 25
    empty = lines / "none"
    empty.mkdir()
    assert spark.read.format("fieldloom_lines").load(str(empty)).count() == 0


def test_torn_lines(spark, lines):
    S.register(spark)
    (lines / "torn.jsonl").write_text('{"stem": "x", "leaves": {"a": 1}, "objects": [{"bbox": [1]}]}\n[]\n{"stem": "y", "leaves": {"a": 2}}\n{"ste')
    with pytest.raises(Exception, match="torn.jsonl, byte 0: not an item"):
        spark.read.format("fieldloom_lines").load(f"{lines}/torn.jsonl").collect()
    rows = spark.read.format("fieldloom_lines").option("torn", "skip").option("category", "staged").load(f"{lines}/torn.jsonl").collect()
    assert [(r.category, r.stem, r.value) for r in rows] == [("staged", "y", "2")]


def test_two_converters_in_one_config(spark, lines, tmp_path):
    (tmp_path / "raw").mkdir()
    for stem in ("3", "77"):
        (tmp_path / "raw" / f"{stem}_view.png").write_bytes(codecs.png_encode(np.zeros((4, 4), np.uint8)))
        (tmp_path / "raw" / f"{stem}_kind.txt").write_text("raw")
    config = {"dataset_root": f"{tmp_path}/set", "converter": [
        {"sources": [f"{tmp_path}/raw"], "globs": {"frame": "*_view.png", "kind": {"pattern": "*_kind.txt", "type": "attr"}}, "id_map": {"c": {"train": 1}}},
        {"object_type": "lines", "sources": [str(lines)], "split": 200, "id_map": {"c": {"test": 2}, "d": {"train": 3}}}]}
    s = N.Session(spark, config)
    assert s.convert() == 41
    found = C.nested(s.refs().collect())["modified"]
    assert set(found["3"]["info"]) == {"frame", "kind", "n", "tags", "0", "1"} and set(found["77"]["info"]) == {"frame", "kind"}
    assert found["3"]["info"]["kind"]["info"]["value"] == "é"  # the later converter holds
    assert sorted((r.class_id, r.scope, r.id) for r in s.ids().collect()) == [("c", "test", 2), ("c", "train", 1), ("d", "train", 3)]
    with pytest.raises(KeyError):
        N.Session(spark, {"dataset_root": "x", "converter": {"object_type": "unheard of"}})
    V.register("nothing", lambda s, own: s.createDataFrame([], N.C.SCHEMA))
    assert V.convert(spark, [{"object_type": "nothing"}]).count() == 0
    with pytest.raises(KeyError):
        V.register("nothing", None)
    del V.CONVERTERS["nothing"]


def test_contents_of_named_files(spark, tmp_path, monkeypatch):
    """Names with blanks and signs, as paths and as Spark's own; only the named files are read."""
    monkeypatch.setattr(S, "HELD", 10)
    names = ["a b.bin", "é%20.bin", "c#d.bin", "plain.bin"]
    for i, n in enumerate(names):
        (tmp_path / n).write_bytes(bytes([i]) * 7)
    rows = [(f"{tmp_path}/{n}", i) for i, n in enumerate(names)] + [(f"file:{tmp_path}/{names[1]}", 1), (f"file://{tmp_path}/{names[2]}", 2), (None, 9)]
    got = S.contents(spark.createDataFrame(rows, "path string, i int").repartition(2)).collect()
    assert len(got) == 6 and all(r.content == bytes([r.i]) * 7 for r in got)
    assert S.contents(spark.createDataFrame([], "path string")).count() == 0
    with pytest.raises(Exception, match="gone"):
        S.contents(spark.createDataFrame([(f"{tmp_path}/gone",)], "path string")).collect()


def tree(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, names in os.walk(root) for f in names if not f.endswith(".crc"))


def test_payload_writer(spark, tmp_path):
    rows = [(f"{tmp_path}/set/{i % 3}/é {i}.bin", bytes([i]) * i) for i in range(30)]
    df = spark.createDataFrame(rows, "file string, content binary").repartition(4)
    K.write_at(df, f"{tmp_path}/set")
    K.write_at(df.limit(5), f"{tmp_path}/set")  # over what is there
    assert tree(tmp_path / "set") == sorted(f"{i % 3}/é {i}.bin" for i in range(30)) and not list((tmp_path / "set").glob(".staging*"))
    assert all(open(f, "rb").read() == c for f, c in rows)
    K.write_at(df.limit(0), f"{tmp_path}/none")
    assert tree(tmp_path / "none") == []


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    """One task of four fails after the others may have ended."""
    import time

    def slow(batches):
        for b in batches:
            time.sleep(0.5)
            yield b

    good = spark.range(20).select(F.concat(F.lit(f"{tmp_path}/set/"), "id").alias("file"), F.lit(b"x").alias("content")).repartition(3)
    bad = spark.range(1).select(F.lit(f"{tmp_path}/set/bad").alias("file"), F.lit(None).cast("binary").alias("content")).mapInArrow(slow, "file string, content binary")
    with pytest.raises(Exception, match="no content for"):
        K.write_at(good.union(bad), f"{tmp_path}/set")
    assert tree(tmp_path) == [] and not list((tmp_path / "set").glob(".staging*"))
    K.write_at(good, f"{tmp_path}/set")
    assert len(tree(tmp_path)) == 20


def test_many_files_are_listed_at_once(spark, sf_dir):
    """500 files take a bounded number of tasks, not one each to be listed."""
    from fieldloom.plans.file_queries import payload_sink

    spark.sparkContext.setJobGroup("listed", "listed")
    try:
        assert payload_sink(spark, sf_dir).count() == 32_000
        tracker = spark.sparkContext.statusTracker()
        stages = {s for j in tracker.getJobIdsForGroup("listed") for s in tracker.getJobInfo(j).stageIds}
        assert 0 < max(i.numTasks for s in stages if (i := tracker.getStageInfo(s))) < 100
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

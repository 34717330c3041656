"""Sources and sinks on a small survey folder of grey and coloured tiles."""

from __future__ import annotations

import io
import json
from pathlib import Path

import numpy as np
import pytest

from fieldloom.functions import codecs
from fieldloom.operators import catalog as C
from fieldloom.sources import discover as S
from fieldloom.sources import sinks as K

GRADIENT = (np.add.outer(np.arange(3) * 40, np.arange(5) * 7) % 256).astype(np.uint8)
COLOURS = np.stack([GRADIENT, 255 - GRADIENT, np.full_like(GRADIENT, 17)], axis=2)


@pytest.fixture(scope="module")
def survey(tmp_path_factory):
    root = tmp_path_factory.mktemp("survey")
    files = {
        "north/tile-7_view.png": codecs.png_encode(COLOURS), "north/tile-7_kind.txt": b"\n oak tree\t\n", "north/tile-8_view.png": codecs.png_encode(GRADIENT),
        "south/tile-8_view.png": codecs.png_encode(GRADIENT), "south/tile-8_kind.txt": b"elm", "south/lonely_view.png": codecs.png_encode(GRADIENT),
        "shared/border.png": codecs.png_encode(GRADIENT), "shapes/leaf/a.png": codecs.png_encode(GRADIENT), "shapes/b.png": codecs.png_encode(GRADIENT),
        "acc/first.npy": codecs.npy_encode(np.full((2, 3, 4), 2.0)), "acc/second.npy": codecs.npy_encode(np.full((2, 3, 4), 3.0)),
    }
    for name, body in files.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(body)
    return root


def test_only_whole_stems_are_found(spark, survey):
    globs = {"view": "*_view.png", "kind": {"pattern": "*_kind.txt", "type": "attr"}}
    rows = S.discover(spark, [f"{survey}/north", f"{survey}/south"], globs, f"{survey}/shared").collect()
    places = {(r.stem, r.name): json.loads(r.value)["dir"] for r in rows}
    assert set(places) == {("tile-7", "view"), ("tile-7", "kind"), ("tile-8", "view"), ("tile-8", "kind"), (None, "border")}
    assert "/south/" in places["tile-8", "view"]  # the later source holds
    listing = spark.read.format("binaryFile").load(f"{survey}/south").select("path")
    assert {r.stem for r in S.discover(spark, [listing], globs).collect()} == {"tile-8"}


def test_payload_readers(spark, survey):
    r = S.read_images(spark, f"{survey}/north/tile-7_view.png").first()
    assert np.array_equal(np.array(r.data).reshape(r.h, r.w, r.channels), COLOURS)
    assert S.read_texts(spark, f"{survey}/north/*.txt").first().value == "oak tree"
    best = S.pick_accumulator(S.read_arrays(spark, f"{survey}/acc")).first()
    assert Path(best.path).name == "second.npy" and best.total == 72 and best.shape == [2, 3, 4]
    masks = S.mask_files(spark, f"{survey}/shapes").collect()
    assert sorted((m.stem, m.class_id) for m in masks) == [("a", "leaf"), ("b", "__unlabeled__")]
    nothing = spark.createDataFrame([("gone", None)], "key string, content binary")
    assert S.decoded_images(nothing, "key").count() == S.decoded_arrays(nothing, "key").count() == 0


def test_ids_of_classes(spark):
    ids = S.id_map(spark, {"oak": {"train": 4, "review": 9}, "elm": {"train": 5}})
    refs = C.flatten(spark, {"modified": {f"t{i}": {"type": "stem", "info": {"class_id": {"type": "attr", "info": {"value": k}}}} for i, k in enumerate(("oak", "elm", "ash"))}})
    assert {(r.stem, r.id) for r in S.with_ids(refs, ids, "train").collect()} == {("t0", 4), ("t1", 5), ("t2", None)}
    assert S.id_map(spark, {}).count() == 0


def test_embedding_bundle(spark, tmp_path):
    held = {"pred_ids": np.array([1, 2]), "gt_ids": np.array([1, 3]), "paths": np.array(["p", "q"]), "embeddings": np.array([[0.5, 1.0], [2.0, -1.0]])}
    np.savez(tmp_path / "whole.npz", **held)
    got = sorted(S.read_embeddings(spark, f"{tmp_path}/whole.npz").collect())
    assert [(r.path, r.gt, r.pred, list(r.v)) for r in got] == [("p", 1, 1, [0.5, 1.0]), ("q", 3, 2, [2.0, -1.0])]
    del held["gt_ids"]
    np.savez(tmp_path / "part.npz", **held)
    with pytest.raises(Exception, match="gt_ids"):
        S.read_embeddings(spark, f"{tmp_path}/part.npz").collect()


def leaf(value, kind="attr"):
    return {"type": kind, "info": {"value": value}}


STORE = {
    "params": {"scale": leaf(2.5)},
    "modified": {
        "t1": {"type": "stem", "info": {"kind": leaf("oak"), "3": {"type": "stem", "info": {"score": leaf([0.25, 0.75])}}}},
        "t2": {"type": "stem", "info": {"kind": leaf("elm")}},
        "t3": {"type": "stem", "info": {"kind": leaf("ash")}},
    },
    "staged": {"t9": {"type": "stem", "info": {"kind": leaf("fir")}}},
}


def test_sidecars(spark, tmp_path):
    bodies = {".meta/dataset_meta.json": json.dumps({"params": STORE["params"]}), "modified/.meta/torn.json": "{", "modified/.meta/list.json": "[1, 2]", "staged/.meta/odd.json": '{"info": {"a": 5, "b": null}}'}
    for category in ("modified", "staged"):
        for stem, tree in STORE[category].items():
            bodies[f"{category}/.meta/{stem}.json"] = json.dumps(tree)
    for name, body in bodies.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    assert C.nested(S.load_store(spark, str(tmp_path)).collect()) == STORE
    with pytest.raises(FileNotFoundError):
        S.load_store(spark, f"{tmp_path}/nowhere")


def test_store_of_versions(spark, tmp_path):
    path = f"{tmp_path}/store"
    refs = C.flatten(spark, STORE)
    K.scatter(refs, path)
    assert C.nested(K.load(spark, path).collect()) == STORE
    edited = C.set_attr(refs, "t2", "kind", "birch").where("stem = 't2'")
    K.save_items(edited, path)  # one of three items of its category
    now = C.nested(K.load(spark, path).collect())
    assert set(now["modified"]) == {"t1", "t2", "t3"} and now["modified"]["t2"]["info"]["kind"]["info"]["value"] == "birch" and now["modified"]["t1"] == STORE["modified"]["t1"]
    K.save_items(C.move(edited, edited.select("stem"), "staged"), path)
    K.save_items(C.flatten(spark, {"params": {"scale": leaf(9), "new": leaf(1)}}), path)
    K.remove_items(spark.createDataFrame([("t9",), ("unknown",)], "stem string"), path)
    now = C.nested(K.load(spark, path).collect())
    assert set(now["modified"]) == {"t1", "t3"} and set(now["staged"]) == {"t2"} and now["params"] == {"scale": leaf(9), "new": leaf(1)}
    K.compact(spark, path, f"{path}-2")
    assert C.nested(K.load(spark, f"{path}-2").collect()) == now
    K.write_bundle(refs, f"{tmp_path}/bundle")
    assert spark.read.json(f"{tmp_path}/bundle").count() == 5


def test_payloads_go_with_items(spark, tmp_path):
    file = lambda d="", kind="image", fmt="png": {"type": kind, "format": fmt, "info": {"dir": d}}
    refs = C.flatten(spark, {"params": {"border": file()}, "modified": {"t1": {"type": "stem", "info": {"view": file(), "kind": leaf("oak"), "2": {"type": "stem", "info": {"mask": file("cut")}}}}, "t2": {"type": "stem", "info": {"view": file()}}}})
    files = {(r.stem, r.name): r.file for r in K.payloads(refs, str(tmp_path)).collect()}
    assert {k: v.removeprefix(f"{tmp_path}/") for k, v in files.items()} == {(None, "border"): "border/border.png", ("t1", "view"): "modified/view/t1.png", ("t1", "mask"): "modified/cut/t1_2.png", ("t2", "view"): "modified/view/t2.png"}
    for f in list(files.values())[:-1]:  # one file is missing
        Path(f).parent.mkdir(parents=True, exist_ok=True)
        Path(f).write_bytes(b"x")
    one = lambda s: spark.createDataFrame([(s,)], "stem string")
    moved = K.move_items(refs, one("t1"), "staged", str(tmp_path))
    assert {r.category for r in moved.where("stem = 't1'").collect()} == {"staged"}
    assert (tmp_path / "staged/cut/t1_2.png").exists() and not (tmp_path / "modified/cut/t1_2.png").exists() and (tmp_path / "border/border.png").exists()
    with pytest.raises(KeyError):
        K.move_items(refs, one("unknown"), "staged", str(tmp_path))
    left = K.delete_items(K.delete_items(moved, one("t1"), str(tmp_path)), one("unknown"), str(tmp_path))
    assert not (tmp_path / "staged/view/t1.png").exists() and {r.stem for r in left.collect()} == {None, "t2"}


def test_routing(spark):
    t = spark.createDataFrame([("s", 0, [1.5]), ("s", 1, None)], "stem string, obj_id int, box array<double>")
    rows = K.routed(t, "box").collect()
    assert len(rows) == 1 and json.loads(rows[0].value) == [1.5] and rows[0].path == ["0"] and rows[0].type == "attr"
    raster = spark.createDataFrame([("s", 2, 3, [0, 9, 0, 9, 9, 0]), ("z", 1, 2, [0, 0])], "stem string, h int, w int, mask array<int>")
    inline = {r.stem: r for r in K.routed(raster, "mask", level="frame").collect()}
    assert inline["s"].type == "rle" and json.loads(inline["s"].value) == {"size": [2, 3], "counts": [1, 3, 2]} and json.loads(inline["z"].value)["counts"] == [2]
    kinds = [(r.type, r.format, json.loads(r.value)["dir"]) for f in (None, ".npy", "txt") for r in K.routed(raster, "mask", "storage", "frame", format_=f, dir_="here" if f else None).limit(1).collect()]
    assert kinds == [("image", "png", "mask"), ("array", "npy", "here"), ("attr", "txt", "here")]
    assert K.routed(raster, "mask", "storage", "frame", type_="segmap", format_="png").first().type == "segmap"
    refs = C.flatten(spark, {"modified": {"s": {"type": "stem", "info": {"kind": leaf("oak"), "7": {"type": "stem", "info": {"score": leaf(2)}}}}}})
    assert {(r.name, tuple(r.path)) for r in K.replace_objects(refs, K.routed(t, "box")).collect()} == {("kind", ()), ("box", ("0",))}


def test_misdetection_files(spark, tmp_path):
    means = spark.createDataFrame([(c, j, c + j / 10) for c in (0, 1) for j in (1, 0, 2)], "cls int, j int, m double")
    K.write_misdetections(spark.range(3), means, str(tmp_path))
    held = np.load(io.BytesIO((tmp_path / "class_means.npz").read_bytes()))
    assert held["ids"].tolist() == [0, 1] and held["means"].tolist() == [[0.0, 0.1, 0.2], [1.0, 1.1, 1.2]]
    assert spark.read.option("header", "true").csv(f"{tmp_path}/misdetected").count() == 3


def test_handlers(spark):
    from fieldloom.sources import handlers as H

    table = spark.createDataFrame([("k", 3, 5, GRADIENT.ravel().tolist())], "stem string, h int, w int, data array<int>")
    for kind in ("image", "segmap", "array"):
        h = H.handler_of(kind)
        back = h.load(h.save(table), "stem").first()
        assert np.array_equal(np.array(back.data).reshape(3, 5), GRADIENT) and back.stem == "k"
    assert set(H.HANDLERS) == {"image", "array", "attr", "rle", "segmap"} and H.handler_of("image").extensions[0] == "png" and not H.handler_of("attr").visual
    assert H.handler_of("attr").load(spark.createDataFrame([("k", b" v ")], "stem string, content binary"), "stem").first().value == "v"
    with pytest.raises(KeyError):
        H.handler_of("video")
    with pytest.raises(KeyError):
        H.register(H.handler_of("rle"))

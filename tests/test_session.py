"""Two flows over a store: the first finds objects, the second works on each of them."""

from __future__ import annotations

import json

import numpy as np
import pytest

from fieldloom.functions import codecs, kernels
from fieldloom.operators import catalog as C
from fieldloom.operators import model as M
from fieldloom.operators import raster as R
from fieldloom.plans import flow as W
from fieldloom.plans import session as N
from fieldloom.sources import sinks as K


@pytest.fixture
def config(tmp_path):
    frame = np.zeros((12, 16), np.uint8)
    frame[2:6, 3:8] = 200
    frame[7:11, 9:14] = 220
    (tmp_path / "raw").mkdir()
    for stem, f in (("a", frame), ("b", 255 - frame), ("c", np.zeros_like(frame))):
        (tmp_path / "raw" / f"{stem}_view.png").write_bytes(codecs.png_encode(f))
        (tmp_path / "raw" / f"{stem}_kind.txt").write_bytes(b"x")
    flows = [
        {"object_type": "flow", "name": "find", "unit": "frame", "processes": [
            {"object_type": "threshold_score", "k": 150, "inputs": {"dist": "frame"}, "outputs": {"mask": {"to": "storage", "level": "frame", "format": ".png", "dir": "found"}}},
            {"object_type": "split_objects", "min_area": 4, "bbox_gap": 0.0, "outputs": {"segment": {"to": "meta", "level": "frame"}, "object": {"level": "frame"}}}]},
        {"object_type": "flow", "name": "each", "unit": "object", "processes": [{"object_type": "box_area", "outputs": {"area": {}}}]},
    ]
    return {"dataset_root": f"{tmp_path}/set", "converter": {"sources": [f"{tmp_path}/raw"], "globs": {"frame": "*_view.png", "kind": {"pattern": "*_kind.txt", "type": "attr"}}, "id_map": {"x": {"train": 1}}}, "flows": flows}


def test_two_flows_over_a_store(spark, config, tmp_path):
    (tmp_path / "session.json").write_text(json.dumps(config))  # JSON is YAML
    s = N.Session(spark, f"{tmp_path}/session.json")
    assert s.refs() is None and s.convert() == 3 and s.convert() == 3
    assert [(r.class_id, r.scope, r.id) for r in s.ids().collect()] == [("x", "train", 1)]
    K.save_items(C.move(s.refs(), spark.createDataFrame([("b",)], "stem string"), "staged").where("stem = 'b'"), s.store)
    seen = []
    s.run(progress=lambda *a: seen.append(a))
    assert seen == [("find", 1, 2), ("find", 2, 2), ("each", 1, 1)]
    found = C.nested(s.refs().collect())
    assert set(found["modified"]) == {"a", "c"} and set(found["staged"]["b"]["info"]) == {"frame", "kind"}  # staged items stay as they are
    a = found["modified"]["a"]["info"]
    boxes = {k: a[k]["info"]["bbox"]["info"]["value"] for k in ("0", "1")}
    assert boxes["0"] == {"x0": 3.0, "y0": 2.0, "x1": 8.0, "y1": 6.0} and a["1"]["info"]["area"]["info"]["value"] == 20
    assert a["segment"]["type"] == "rle" and a["mask"]["info"] == {"dir": "found"} and set(found["modified"]["c"]["info"]) == {"frame", "kind"}
    mask = codecs.png_decode((tmp_path / "set/modified/found/a.png").read_bytes())
    assert (mask > 0).sum() == 40
    s.run()  # once more over what is there: the same objects
    assert C.nested(s.refs().collect())["modified"]["a"]["info"]["1"] == a["1"]


def test_configs_are_checked(spark, config):
    assert N.flow_of({"object_type": "flow", "unit": "frame", "processes": ["mask_box"]}).steps
    with pytest.raises(KeyError):
        N.flow_of({"unit": "frame", "colour": 1})
    with pytest.raises(KeyError):
        W.Flow(processes=[{"op": "segment", "model": {"type": "unheard of"}}]).steps[0][0].plan(spark.range(1))
    fields = {"text": "only the body", "conf": 0.0, "hole_debug": True, "hole_edge_gray": False, "hole_seed_dense_min": 4, "hole_neg_pts_area_frac": 0.02, "hole_logit_neg": -5.0}
    assert W.Flow(processes=[{"op": "segment_with_hole", **fields}]).steps[0][0].holes().hole_logit_neg == -5.0


def test_per_pixel_models_between_flows(spark):
    grey = [90, 90, 90] * 4
    frames = spark.createDataFrame([(k, 2, 2, grey) for k in range(5)] + [(9, 2, 2, [0, 0, 250] + [90, 90, 90] * 3)], "stem bigint, h int, w int, frame array<int>")
    names = ("mean_c0", "mean_c1", "std_c0", "std_c1")
    learn = W.Flow(processes=["convert_to_chroma", {"op": "accumulate_chroma_histogram", "per_pixel": True}], carry=["c0_acc", "c1_acc"], finalize_processes=[{"op": "robust_chroma_stats", "outputs": {n: {} for n in names}}])
    find = W.Flow(processes=["chroma_distance", {"op": "threshold_score", "k": 5, "outputs": {"mask": {"level": "frame"}}}])
    results, params = W.run_flows([learn, find], frames)
    assert [list(params["mean_c1"].first().value)] == [[0.0] * 4]
    assert [(r.stem, list(r.mask)) for r in results[1].tables["mask"].collect()] == [(9, [255, 0, 0, 0])]


def test_holes_with_their_maps(spark):
    frame = np.full((40, 40), 20)
    frame[5:35, 5:35] = 200
    frame[15:25, 15:25] = 40
    objects = [("x", (4.0, 4.0, 36.0, 36.0))]

    class Whole(M.BoxThreshold):
        """Decodes all of the box, as a model that fills holes does, but for negative points."""

        def decode(self, state, box, points, logits):
            mask, score, out = super().decode(np.full(state.shape, 1.0), box, points, None)
            out[6:34, 6:34] = np.maximum(out[6:34, 6:34], 1) if not points else out[6:34, 6:34]
            return (out > 0).astype(np.uint8) * 255 if not points else np.where(np.arange(40)[:, None] < 34, 255, 0) * np.ones((40, 40), np.uint8), score, out

    labels, kept, maps = M.segmented(Whole(), frame, objects, 0.0, 1, M.HoleConfig(hole_dark_boost=False, hole_debug=True))
    assert len(kept) == 1 and maps["hole_seed"][15:25, 15:25].all() and maps["seg_raw"][20, 20] == 255 and labels[20, 20] == 0 and labels[10, 10] == 1
    plain, _, _ = M.segmented(Whole(), frame, objects, 0.0, 1, M.HoleConfig(preserve_holes=False))
    assert plain[20, 20] == 1
    frames = spark.createDataFrame([(1, 40, 40, frame.ravel().tolist())], "stem bigint, h int, w int, frame array<int>")
    chain = [{"op": "threshold_score", "k": 100, "inputs": {"dist": "frame"}}, {"op": "split_objects", "min_area": 4}]
    got = W.run_flow(W.Flow(processes=[*chain, {"op": "segment_with_hole", "conf": 0.0, "min_area": 1, "hole_debug": True, "outputs": {n: {"level": "frame"} for n in ("segment", "seg_raw", "hole_seed", "hole_grown", "hole_edge")}}]), frames)
    assert all(t.count() == 1 for t in got.tables.values()) and len(got.tables) == 5


def test_borders_and_changes(spark):
    r = np.random.default_rng(3)
    for gap in (1, 2, 5):
        m = (r.random((9, 13)) > 0.6).astype(np.uint8) * 255
        px = spark.createDataFrame([(1, y, x, int(m[y, x])) for y in range(9) for x in range(13)], "stem int, y int, x int, v int")
        want = np.zeros_like(m)
        for p in R.bridge_border(px, "v", gap, 9, 13).collect():
            want[p.y, p.x] = p.v
        assert np.array_equal(kernels.bridge_border(m, gap), want)
    frames = spark.createDataFrame([(1, 2, 2, [255] * 4, [1, 1, 1, 0]), (2, 2, 2, [255] * 4, [1, 0, 0, 0])], "stem bigint, h int, w int, mask array<int>, other array<int>")
    out = lambda **c: {x.stem: sum(v > 0 for v in x.mask) for x in W.run_flow(W.Flow(processes=[{"op": "combine_mask", **c, "outputs": {"mask": {"level": "frame"}}}]), frames).tables["mask"].collect()}
    assert out() == {1: 1, 2: 3} and out(max_change=-0.5) == {1: 4, 2: 3} and out(max_change=-0.5, drop_on_over=True) == {2: 3}

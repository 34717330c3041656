from __future__ import annotations

import pytest

from fieldloom.plans import flow as W


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(1, 2, 2, [0, 9, 9, 0]), (2, 2, 2, [0, 0, 0, 0]), (3, 2, 2, [9, 9, 9, 9])]
    return spark.createDataFrame(rows, "stem bigint, h int, w int, frame array<int>")


STEP = {"op": "threshold_score", "inputs": {"dist": "frame"}}


def test_unknown_ports_and_config():
    with pytest.raises(KeyError):
        W.Flow(processes=[{"op": "threshold_score", "inputs": {"nope": "frame"}}])
    with pytest.raises(KeyError):
        W.Flow(processes=[{"op": "threshold_score", "slots": {"nope": "x"}}])
    with pytest.raises(KeyError):
        W.Flow(processes=[{"op": "threshold_score", "nope": 1}])
    with pytest.raises(KeyError):
        W.Flow(processes=["no_such_operator"])


def test_shared_wins_unless_told():
    assert W.Flow(shared={"k": 7, "space": "hsv"}, processes=[STEP | {"k": 5}]).steps[0][0].config["k"] == 7
    assert W.Flow(shared={"k": 7}, processes=[STEP | {"k": 5}], step_wins=True).steps[0][0].config["k"] == 5


def test_skip_keeps_earlier_outputs(frames):
    flow = W.Flow(processes=[STEP | {"k": 5, "outputs": {"mask": {"level": "frame"}}}, {"op": "combine_mask", "mode": "intersect", "inputs": {"other": "none"}}, {"op": "mask_box", "outputs": {"bbox": {"level": "frame"}}}])
    units = frames.selectExpr("*", "if(stem = 1, array(0,0,0,0), array(1,1,1,1)) AS none")
    out = W.run_flow(flow, units)
    assert {r.stem for r in out.tables["mask"].collect()} == {1, 3}
    assert {r.stem for r in out.tables["bbox"].collect()} == {3}


def test_object_output_without_objects_is_skipped(frames):
    out = W.run_flow(W.Flow(processes=[STEP | {"k": 5, "outputs": {"mask": {}}}]), frames)
    assert out.skipped == ["mask"] and not out.tables


def test_first_object_covers_frame(spark, frames):
    objects = spark.createDataFrame([(1, 0, [1, 1, 1, 1]), (1, 1, [2, 2, 2, 2]), (3, 4, [5, 5, 5, 5])], "stem bigint, obj_id int, frame array<int>")
    units = {r.stem: r.frame for r in W.units_of(W.Flow(), frames, objects).collect()}
    assert units == {1: [1, 1, 1, 1], 2: None, 3: [5, 5, 5, 5]}
    assert W.units_of(W.Flow(unit="object"), frames, objects).count() == 3


def test_carry_finalize_cache(frames):
    spec = dict(processes=[{"op": "accumulate_histogram", "inputs": {"image": "frame"}}], carry=["acc"], finalize_processes=[{"op": "robust_stats", "outputs": {"mean_c0": {}, "std_c0": {}}}], cacheable=True)
    seen = []
    results, params = W.run_flows([W.Flow(name="bg", **spec), W.Flow(**spec)], frames, progress=lambda *a: seen.append(a))
    assert params["mean_c0"] == 0.0 and params["std_c0"] == pytest.approx(9 / 1.349)
    assert not results[0].cached and results[1].cached and seen == [("bg", 1, 1), ("flow", 1, 1)]
    with pytest.raises(ValueError):
        W.Flow(unit="object", carry=["acc"])


def test_progress_and_skips(spark):
    """Steps in order while a flow runs, with the units that each kept; every job counts as it goes."""
    blank, spot = [0] * 16, [0] * 5 + [200] + [0] * 10
    frames = spark.createDataFrame([(k, 4, 4, spot if k % 3 == 0 else blank) for k in range(10)], "stem bigint, h int, w int, frame array<int>")
    flow = W.Flow(name="find", processes=[STEP | {"k": 5, "outputs": {"mask": {"level": "frame"}}}, {"op": "split_objects", "min_area": 1}, {"op": "order_objects", "outputs": {"object": {"level": "frame"}}}])
    seen = []
    results, _ = W.run_flows([flow], frames, progress=lambda *a: seen.append(a))
    assert seen == [("find", 1, 3), ("find", 2, 3), ("find", 3, 3)]
    kept = results[0].counts()
    assert kept == [(10, 4), (4, 4), (4, 4)] and sum(a - b for a, b in kept) == 6
    assert results[0].tables["mask"].count() == 4
    quiet, _ = W.run_flows([flow], frames)
    assert quiet[0].seen == [] and quiet[0].counts() == []


def test_background_model_then_objects(spark):
    grey = [90, 90, 90]
    red = [0, 0, 250]
    blank, marked = grey * 16, (red * 2 + grey * 2) * 2 + grey * 8
    frames = spark.createDataFrame([(k, 4, 4, blank) for k in range(5)] + [(9, 4, 4, marked)], "stem bigint, h int, w int, frame array<int>")
    learn = W.Flow(processes=["convert_to_chroma", "accumulate_chroma_histogram"], carry=["c0_acc", "c1_acc"], finalize_processes=[{"op": "robust_chroma_stats", "outputs": {n: {} for n in ("mean_c0", "mean_c1", "std_c0", "std_c1")}}])
    find = W.Flow(shared={"space": "hsv"}, processes=["chroma_distance", {"op": "threshold_score", "k": 5}, {"op": "split_objects", "min_area": 1, "outputs": {"segment": {"level": "frame"}}}, {"op": "order_objects", "outputs": {"object": {"level": "frame"}}}])
    results, params = W.run_flows([learn, find], frames)
    assert params["mean_c1"] == 0 and params["std_c1"] == 0
    (row,) = results[1].tables["object"].collect()
    assert row.stem == 9 and [tuple(o.bbox) for o in row.object] == [(0, 0, 2, 2)] and row.object[0].class_id == "__unclassified__"
    per_pixel = W.Flow(processes=["convert_to_chroma", {"op": "accumulate_chroma_histogram", "per_pixel": True}], carry=["c0_acc", "c1_acc"], finalize_processes=[{"op": "robust_chroma_stats", "outputs": {"mean_c1": {}}}])
    assert W.run_flow(per_pixel, frames).params.count() == 16
    assert W.run_flow(W.Flow(processes=["chroma_distance", {"op": "threshold_score", "outputs": {"mask": {"level": "frame"}}}]), frames).tables["mask"].count() == 0


def test_mask_sizes_and_models(spark):
    frames = spark.createDataFrame([(1, 4, 6, [0] * 7 + [9, 9, 9] + [0] * 14)], "stem bigint, h int, w int, frame array<int>")
    seen = W.run_flow(W.Flow(processes=[STEP | {"k": 5}, {"op": "frame_crop", "outputs": {"crop": {"level": "frame"}}}]), frames)
    assert list(seen.tables["crop"].first().crop) == [9, 9, 9]
    seen = W.run_flow(W.Flow(processes=[STEP | {"k": 5}, {"op": "normalize_mask", "target_shape": 5, "outputs": {"mask": {"level": "frame"}}}]), frames)
    assert len(seen.tables["mask"].first().mask) == 25 and sum(seen.tables["mask"].first().mask) == 3 * 255
    chain = [STEP | {"k": 5}, {"op": "split_objects", "min_area": 1, "bbox_gap": 1.0}]
    for op in ("segment", "segment_with_hole"):
        got = W.run_flow(W.Flow(processes=[*chain, {"op": op, "min_area": 1, "outputs": {"segment": {"level": "frame"}}}]), frames)
        assert sum(v > 0 for v in got.tables["segment"].first().segment) == 3
    assert {"convert_to_chroma", "normalize_color", "chroma_distance", "accumulate_chroma_histogram", "robust_chroma_stats", "threshold_score", "combine_mask", "morph_mask", "normalize_mask", "frame_crop", "split_objects", "order_objects", "detect_edge", "close_edge", "fill_edge", "edge_blob", "remove_edge_holes", "segment", "segment_with_hole"} <= set(W.OPERATORS)


def test_edge_chain_and_colour(spark):
    frame = [0] * 72 + [200] * 72
    frames = spark.createDataFrame([(1, 12, 12, frame)], "stem bigint, h int, w int, frame array<int>")
    flow = W.Flow(processes=[{"op": "detect_edge", "outputs": {"edge": {"level": "frame"}}}, {"op": "close_edge", "size": 3}, {"op": "fill_edge", "outputs": {"mask": {"level": "frame"}}}, {"op": "morph_mask", "open_size": 1}])
    out = W.run_flow(flow, frames)
    assert out.tables["edge"].count() == 1 and out.tables["mask"].count() == 1
    colour = spark.createDataFrame([(1, 1, 1, [0, 0, 100])], "stem bigint, h int, w int, frame array<int>")
    made = W.run_flow(W.Flow(processes=[{"op": "normalize_color", "outputs": {"norm_image": {"level": "frame"}}}]), colour)
    assert list(made.tables["norm_image"].first().norm_image) == [0, 0, 255]


def test_arguments():
    from fieldloom.plans import arguments as A

    got = {a.name: a for a in A.arguments("segment_with_hole")}
    assert got["hole_max_pts"].high == 32 and got["hole_space"].choices == ("lab", "hsv", "rgb") and got["text"].kind == "str"
    assert A.outside("segment_with_hole", {"conf": 1.5, "hole_space": "cmyk", "hole_max_pts": 3}) == ["conf", "hole_space"]
    assert all(A.outside(op, {a.name: a.default for a in A.arguments(op) if a.default is not None}) == [] for op in W.OPERATORS)

from __future__ import annotations

import pytest

from fieldloom.functions.codecs import png_decode
from fieldloom.operators import raster as R
from fieldloom.operators import regions as G
from fieldloom.operators.history import EditHistory
from fieldloom.plans import analyses
from fieldloom.sources import sinks

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"


@pytest.fixture(scope="module")
def objects(spark):
    rows = [("s", 0, "", (0.0, 0.0, 2.0, 2.0)), ("s", 1, "b", (4.0, 4.0, 6.0, 6.0)), ("s", 3, "c", (1.0, 1.0, 8.0, 8.0)), ("t", 0, "d", None)]
    return spark.createDataFrame(rows, f"stem string, obj_id int, class_id string, bbox {BOX}")


def test_merge(spark, objects):
    got = {(r.stem, r.obj_id): r for r in G.merge_objects(objects, spark.createDataFrame([("s", 0), ("s", 1), ("t", 0)], "stem string, obj_id int")).collect()}
    assert set(got) == {("s", 0), ("s", 3), ("t", 0)}
    assert got["s", 0].class_id == "b" and tuple(got["s", 0].bbox) == (0, 0, 6, 6)


def test_ids(spark, objects):
    assert {r.stem: r.next_id for r in G.next_id(objects).collect()} == {"s": 2, "t": 1}
    more = G.add_object(objects, spark.createDataFrame([("s",), ("u",)], "stem string"))
    assert {(r.stem, r.obj_id) for r in more.collect()} - {(r.stem, r.obj_id) for r in objects.collect()} == {("s", 2), ("u", 0)}
    assert {r.obj_id for r in G.rename_object(objects, 1, 0).where("stem = 's'").collect()} == {0, 1, 3}
    assert {r.obj_id for r in G.rename_object(objects, 1, 9).where("stem = 's'").collect()} == {0, 9, 3}
    assert G.delete_objects(objects, spark.createDataFrame([("s", 1)], "stem string, obj_id int")).count() == 3


def test_order_puts_boxless_last(spark, objects):
    px = spark.createDataFrame([("s", y, x, 1 if y < 2 else 2) for y in range(8) for x in range(8) if y < 2 or y > 3], "stem string, y int, x int, label int")
    moved, out = G.order_objects(px, objects, 8, 8)
    ids = {(r.stem, r.old_id): r.obj_id for r in out.collect()}
    assert ids == {("s", 3): 0, ("s", 1): 1, ("s", 0): 2, ("t", 0): 0}
    assert {r.label for r in moved.collect()} == {1, 3}  # label 2 is claimed by both 3 and 1: the nearer has it


def test_history(spark):
    h = EditHistory(spark.range(0))
    for n in (1, 2):
        h.commit(spark.range(n))
    assert [h.undo().count() for _ in range(3)] == [1, 0, 0] and h.redo().count() == 1
    h.commit(spark.range(9))
    assert h.redo().count() == 9 and len(h.states) == 3


def test_run_length_text_and_files(spark, tmp_path):
    mask = spark.createDataFrame([("a", 2, 3, [0, 1, 1, 0, 0, 1]), ("b", 2, 3, [0] * 6)], "stem string, h int, w int, data array<int>")
    runs = R.rle_runs(R.to_pixels(mask), "v", 2, 3)
    back = G.rle_from_strings(G.rle_strings(runs))
    assert {r.stem: list(r.counts) for r in back.collect()} == {r.stem: list(r.counts) for r in runs.collect()} == {"a": [2, 1, 1, 2], "b": [6]}
    sinks.write_files(sinks.encoded(mask), str(tmp_path))
    assert png_decode((tmp_path / "a.png").read_bytes()).tolist() == [[0, 1, 1], [0, 0, 1]]
    sinks.copy_files(spark.createDataFrame([(f"{tmp_path}/a.png", f"{tmp_path}/sub/c.png")], "source string, target string"))
    assert (tmp_path / "sub/c.png").exists() and (tmp_path / "a.png").exists()


def test_paint_and_bridge(spark):
    stems = spark.createDataFrame([("s",)], "stem string")
    fg = spark.createDataFrame([("s", 0, 0)], "stem string, y int, x int")
    disc = R.paint_disc(fg, stems, 3, 3, 1, 8, 8)
    assert disc.count() == 6 and R.paint_disc(disc, stems, 3, 3, 1, 8, 8, erase=True).count() == 1
    assert R.paint_polygon(fg, stems, [(0, 0), (1, 1)], 8, 8).count() == 1
    assert R.paint_polygon(fg, stems, [(1.5, 1.5), (5.5, 1.5), (5.5, 5.5), (1.5, 5.5)], 8, 8).count() == 17


def test_reports(spark):
    members = spark.createDataFrame([(1, 0), (1, 0), (1, 2)], "cluster int, class int")
    a = analyses.ANALYSES["purity"]
    assert a.format_report(a.analyze(members)) == "cluster 1: 3, 0 0.67"

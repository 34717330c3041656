from __future__ import annotations

import colorsys

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import expressions as E
from fieldloom.operators import catalog as C
from fieldloom.operators import diagnostics as D
from fieldloom.operators import raster as R
from fieldloom.plans.sampling import classification_samples, split
from fieldloom.streaming.histograms import windowed_counts

COLOURS = [(0, 0, 0), (255, 255, 255), (255, 0, 0), (0, 255, 0), (0, 0, 255), (12, 200, 90), (7, 7, 9), (250, 128, 3)]


@pytest.fixture(scope="module")
def bgr(spark):
    return spark.createDataFrame(COLOURS, "b int, g int, r int")


def test_hsv_there_and_back(bgr):
    h, s, v = E.bgr_to_hsv(F.col("b"), F.col("g"), F.col("r"))
    rows = bgr.select("b", "g", "r", h.alias("h"), s.alias("s"), v.alias("v"))
    back = E.hsv_to_bgr(F.col("h"), F.col("s"), F.col("v"))
    for x in rows.select("*", *[c.alias(n) for c, n in zip(back, ("b2", "g2", "r2"))]).collect():
        hh, ss, vv = colorsys.rgb_to_hsv(x.r / 255, x.g / 255, x.b / 255)
        assert abs((x.h - hh * 180 + 90) % 180 - 90) <= 1 and abs(x.s - ss * 255) <= 1 and x.v == round(vv * 255)
        assert max(abs(x.b - x.b2), abs(x.g - x.g2), abs(x.r - x.r2)) <= 4  # hue has steps of 2 degrees


def test_lab_of_greys_and_primaries(bgr):
    a, b = E.bgr_to_lab_ab(F.col("b"), F.col("g"), F.col("r"))
    got = {(x.b, x.g, x.r): (x.a_, x.b_) for x in bgr.select("b", "g", "r", a.alias("a_"), b.alias("b_")).collect()}
    assert got[0, 0, 0] == got[255, 255, 255] == (128, 128)
    assert got[0, 0, 255] == (208, 195) and got[0, 255, 0] == (42, 211) and got[255, 0, 0] == (207, 20)


def test_normalized_colour_has_full_value(bgr):
    out = E.normalize_color(F.col("b"), F.col("g"), F.col("r"))
    assert all(max(x) == 255 for x in bgr.select(*out).collect())


def test_names(spark):
    df = spark.createDataFrame([("s0_pose.png",), ("_pose.png",), ("x.PNG",), ("s0_pose.txt",)], "n string")
    assert [r[0] for r in df.select(E.extract_stem(F.col("n"), "*_pose.png")).collect()] == ["s0", "", None, None]
    assert [r[0] for r in df.select(E.infer_type(E.file_extension(F.col("n")))).collect()] == ["image"] * 3 + ["attr"]
    with pytest.raises(Exception, match="unknown file extension"):
        df.select(E.infer_type(F.lit(".xyz"), strict=True)).collect()


def test_deltas_and_palette(spark):
    df = spark.createDataFrame([(178, 2), (10, 50)], "v int, mu int")
    assert [r[0] for r in df.select(E.channel_delta(F.col("v"), F.col("mu"), True, 180)).collect()] == [4, 40]
    assert [r[0] for r in df.select(E.channel_delta(F.col("v"), F.col("mu"), False, 180)).collect()] == [176, -40]
    hues = [r[0] for r in spark.range(12).select(E.palette_hue(F.col("id"))).collect()]
    assert len(set(hues)) == 12 and all(0 <= h < 180 for h in hues)


def test_robust_circular_straddles_zero(spark):
    hist = spark.createDataFrame([(1, b, w) for b, w in ((178, 3), (179, 5), (0, 6), (1, 5), (2, 3))], "g int, bin int, w bigint")
    r = R.robust_stats(hist, ["g"], 180, True).first()
    assert r.mu == 0 and r.sigma == pytest.approx(2 / 1.349)


def test_variance_partition_without_valid_pixels(spark):
    px = spark.createDataFrame([(1.0, 1.0, 2)], "mu double, sigma double, n bigint")
    r = D.variance_partition(px, False, 256, 10).first()
    assert r.valid_px == 0 and r.spatial_fraction is None
    r = D.variance_partition(px, True, 180, 1).first()
    assert r.valid_px == 1 and 0 <= r.spatial_fraction <= 1


def test_samples(spark):
    ids = spark.range(4000).withColumnRenamed("id", "k")
    n = {r.split: r["count"] for r in split(ids, "k").groupBy("split").count().collect()}
    assert 3050 < n["train"] < 3350 and split(ids, "k", excluded=ids.limit(10)).count() == 3990
    leaf = lambda v: {"type": "attr", "info": {"value": v}}
    refs = C.flatten(spark, {"staged": {"s": {"type": "stem", "info": {"class_id": leaf("F"), "0": {"type": "stem", "info": {"class_id": leaf("A")}}}}}, "modified": {"t": {"type": "stem", "info": {"0": {"type": "stem", "info": {"class_id": leaf("B")}}}}}})
    (r,) = classification_samples(refs).collect()
    assert (r.class_id, r.sample_id, r.stem, r.obj_id) == ("A", "s_0", "s", "0")
    assert classification_samples(refs, unit="frame").first().class_id == "F"


def test_windowed_counts(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    assert windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()

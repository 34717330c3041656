"""SMP-SPLIT: train, validation and test samples from approved items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.expressions import hash_bucket

RATIOS = {"train": 8000, "val": 1000, "test": 1000}


def split(samples: DataFrame, key: str, ratios: dict[str, int] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """Adds ``split`` by the hash of the key; the same key always lands alike. ``excluded(key)`` rows are left out."""
    ratios = ratios or RATIOS
    if excluded is not None:
        samples = samples.join(excluded.select(key), key, "left_anti")
    b, out, top = hash_bucket(F.col(key), sum(ratios.values())), None, 0
    for name, n in ratios.items():
        top += n
        out = F.when(b < top, name) if out is None else out.when(b < top, name)
    return samples.withColumn("split", out)


def classification_samples(refs: DataFrame, unit: str = "object", ratios: dict[str, int] | None = None, excluded: DataFrame | None = None) -> DataFrame:
    """``(split, class_id, sample_id, stem, obj_id)`` of staged items: one sample per object, or per frame."""
    own = refs.where("category = 'staged' AND name = 'class_id'")
    value = F.get_json_object(F.concat(F.lit('{"v":'), "value", F.lit("}")), "$.v")
    if unit == "object":
        own = own.where("size(path) = 1").select(value.alias("class_id"), F.concat_ws("_", "stem", F.element_at("path", 1)).alias("sample_id"), "stem", F.element_at("path", 1).alias("obj_id"))
    else:
        own = own.where("size(path) = 0").select(value.alias("class_id"), F.col("stem").alias("sample_id"), "stem", F.lit(None).cast("string").alias("obj_id"))
    return split(own, "sample_id", ratios, excluded).select("split", "class_id", "sample_id", "stem", "obj_id")

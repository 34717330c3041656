"""Converters: how raw input becomes catalogue rows. A config names one by ``object_type`` (``glob``, where it doesn't), or lists several."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import catalog as C

from . import discover, files

#: A converter makes catalogue rows, items and params, of a config; ``id_map`` is read by the session.
Converter = Callable[[SparkSession, dict[str, Any]], DataFrame]
CONVERTERS: dict[str, Converter] = {}


def register(name: str, converter: Converter) -> None:
    if name in CONVERTERS:
        raise KeyError(f"a converter {name} exists")
    CONVERTERS[name] = converter


def checked(config: dict | list | None) -> list[tuple[Converter, dict[str, Any]]]:
    """The converters of a config with their own fields; unknown names are a KeyError before anything is read."""
    out = []
    for own in config if isinstance(config, list) else [config] if config else []:
        own = dict(own)
        name = own.pop("object_type", "glob")
        if name not in CONVERTERS:
            raise KeyError(f"no converter {name}")
        out.append((CONVERTERS[name], own))
    return out


def convert(spark: SparkSession, config: dict | list) -> DataFrame:
    """Rows of all converters; of a leaf that several have, the last holds."""
    rows = None
    for converter, own in checked(config):
        found = converter(spark, own)
        rows = found if rows is None else over(rows, found)
    if rows is None:
        raise KeyError("the config has no converter")
    return rows


def over(old: DataFrame, new: DataFrame) -> DataFrame:
    """Catalogue rows of both; where both have a leaf the new one holds."""
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in C.KEY]
    keys = new.select(*[F.col(k).alias(f"_{k}") for k in C.KEY]).distinct()
    return old.join(keys, same, "left_anti").unionByName(new.select(old.columns))


def _glob(spark: SparkSession, own: dict[str, Any]) -> DataFrame:
    return discover.discover(spark, own["sources"], own["globs"], own.get("params"))


def _lines(spark: SparkSession, own: dict[str, Any]) -> DataFrame:
    """``{sources: [...], split?, category?, torn?}``: annotation files, see ``files.LineSource``."""
    files.register(spark)
    rows = None
    for source in own["sources"]:
        read = spark.read.format(files.LineSource.name())
        for k in ("split", "category", "torn"):
            if k in own:
                read = read.option(k, str(own[k]))
        found = read.load(source)
        rows = found if rows is None else over(rows, found)
    return rows


register("glob", _glob)
register("lines", _lines)

"""Payload handlers: how each type of leaf is read and written. A handler turns ``(key, content)`` rows into values and
back; moving, copying and deleting files is the same for all and lies in ``sinks``."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions.expressions import EXTENSIONS

from . import discover, sinks


@dataclass(frozen=True)
class Handler:
    """``load(files, key)`` and ``save(table)`` are None for inline leaves, whose value is in the catalogue."""

    kind: str
    default_format: str
    visual: bool
    load: Callable[[DataFrame, str], DataFrame] | None = None
    save: Callable[[DataFrame], DataFrame] | None = None

    @property
    def extensions(self) -> list[str]:
        return EXTENSIONS.get(self.kind, [])


HANDLERS: dict[str, Handler] = {}


def register(handler: Handler) -> None:
    if handler.kind in HANDLERS:
        raise KeyError(f"a handler of {handler.kind} exists")
    HANDLERS[handler.kind] = handler


def handler_of(kind: str) -> Handler:
    if kind not in HANDLERS:
        raise KeyError(f"no handler of {kind}")
    return HANDLERS[kind]


def _texts(files: DataFrame, key: str) -> DataFrame:
    return files.where("content IS NOT NULL").select(key, discover.attr_text(F.col("content")).alias("value"))


register(Handler("image", "png", True, discover.decoded_images, lambda t: sinks.encoded(t, "png")))
register(Handler("segmap", "png", True, discover.decoded_segmaps, lambda t: sinks.encoded(t, "png")))
register(Handler("array", "npy", False, discover.decoded_arrays, lambda t: sinks.encoded(t, "npy")))
register(Handler("attr", "str", False, _texts))
register(Handler("rle", "", True))

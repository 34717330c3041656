"""Bounded labelled samples with features computed on the executors."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_texts, text_rows
from .linear import PackedRows, Rows, packed, unpacked


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; rows of remainder 2 are never learnt from."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def kept_apart(ids: np.ndarray) -> np.ndarray:
    """A fifth of the sampled rows, by a hash of the id, for the curve from margins to probabilities."""
    return (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(5) == 0


def sample(docs: DataFrame, labels: DataFrame, label_col: str, limit: int, kernel: Callable, id_col: str = "doc_id", text_col: str = "text") -> tuple[Rows | PackedRows, np.ndarray, np.ndarray]:
    """Features of at most ``limit`` labelled rows, with their labels and ids.

    The rows are those of the least hash of the id, so the sample doesn't depend on the partitioning. Labels
    that are null are left out; of several labels of an id the largest holds, of several texts each is a row
    (the first ``limit`` by id). ``kernel`` yields sorted ``idx`` and ``val`` arrays for each text; an empty ``val`` stands
    for ones. They come to the driver packed, differences of columns in about 2 bytes an entry; rows without values stay so.
    """
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("label").isNotNull() & F.col("label_id").isNotNull() & (fold(F.col("label_id")) != 2))
        .groupBy("label_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("label_id"), "label_id").limit(limit)
    )
    # at most `limit` rows of two numbers: small enough to send to every executor
    rows = text_rows(docs, id_col, text_col)
    own = rows.join(F.broadcast(marked), rows.doc_id == marked.label_id, "left_semi")
    got = map_texts(own, lambda: _packed(kernel()), "doc_id long, n int, idx binary, val binary").join(F.broadcast(marked), F.col("doc_id") == F.col("label_id")).select("doc_id", "label", "n", "idx", "val").orderBy("doc_id").limit(limit).toArrow()
    label, ids = got.column("label").to_numpy().astype(float), got.column("doc_id").to_numpy()
    if not any(got.column("val").to_pylist()):
        rows: Rows | PackedRows = PackedRows(got.column("idx").to_pylist())
    else:
        values = (np.frombuffer(zlib.decompress(v) if v else b"", np.float32) for v in got.column("val").to_pylist())
        rows = Rows.filled(got.column("n").to_numpy(), map(unpacked, got.column("idx").to_pylist()), values)
    del got
    release()
    return rows, label, ids


def release() -> None:
    """Hand freed memory back, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _packed(apply: Callable) -> Callable:
    """A kernel whose arrays come as compressed bytes; no values, no bytes."""

    def run(ids, texts):
        out = apply(ids, texts)
        return {"doc_id": ids, "n": [len(i) for i in out["idx"]], "idx": [packed(i) for i in out["idx"]], "val": [zlib.compress(np.asarray(v, np.float32).tobytes(), 1) if len(v) else b"" for v in out["val"]]}

    return run


def scored(docs: DataFrame, kernel: Callable, threshold: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` of a kernel that yields scores."""
    rows = map_texts(text_rows(docs, id_col, text_col), kernel, "doc_id long, score double")
    return rows.select(
        "doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )

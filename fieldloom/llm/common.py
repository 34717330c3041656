"""Helpers shared by the training-data operators.

Conventions that hold for every operator here:

* only the id and text columns are read, so extra or clashing columns never matter;
* a null text counts as the empty text, a null id stays null;
* repeated rows give repeated result rows;
* an empty table gives an empty result with the same schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.scratch import removed_at_exit, shared_dir

#: Texts are handed to Python kernels in slices of at most so many characters (one text at least).
SLICE_CHARS = 2_000_000
#: Arrow batches have about so many bytes (one row at least).
BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` with null texts as empty ones."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(texts: list[str], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Consecutive index ranges whose texts have at most ``limit`` characters together."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, where the session doesn't say otherwise: a worker holds few texts at a time."""
    if spark.conf.get(BATCH_KEY, None) is None:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)


def fresh(columns: list[str], name: str) -> str:
    """A column name that is not taken, in any case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_texts(rows: DataFrame, kernel: Callable[[], Callable[[list, list], dict]], schema: str, limit: int = SLICE_CHARS) -> DataFrame:
    """Map ``(doc_id, text)`` rows through a Python kernel over Arrow batches.

    ``kernel()`` is called once per task and returns a function from (ids, texts) to a dict of columns;
    memory is bounded by one Arrow batch plus one slice of texts.
    """
    from pyspark.sql.types import StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = kernel()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, limit):
                columns = apply(ids[a:b], texts[a:b])
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in arrow], schema=arrow)

    small_batches(rows.sparkSession)
    return rows.select("doc_id", "text").mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder. Files there outlive executors, so a lost one costs no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Written to the shared folder as Parquet and read again; it goes when the driver's program ends."""
    path = removed_at_exit(df.sparkSession, f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filter_texts(docs: DataFrame, kernel: Callable[[], Callable[[list], list]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, for whose texts the kernel says true; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = kernel()
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            keep = [k for a, b in slices(texts) for k in apply(texts[a:b])]
            yield batch.filter(pa.array(keep, pa.bool_()))

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)



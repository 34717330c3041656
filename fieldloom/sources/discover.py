"""Sources: loose files to catalogue rows, and payload readers.

Files are listed and read by Spark's ``binaryFile`` source, so any path Spark reaches will do.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import codecs, images
from fieldloom.functions.expressions import extract_stem, file_extension, infer_type
from fieldloom.operators.catalog import MODIFIED, SCHEMA

FILE = r"([^/]*)$"


def listed(spark: SparkSession, folder: str | DataFrame, recursive: bool = False) -> DataFrame:
    """``(path, name)`` of the files of a folder; their contents aren't read. A table with ``path`` is a listing already."""
    if isinstance(folder, DataFrame):
        return folder.select("path", F.regexp_extract("path", FILE, 1).alias("name"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(folder)
    return files.select("path", F.regexp_extract("path", FILE, 1).alias("name"))


def discover(spark: SparkSession, sources: list[str | DataFrame], globs: dict[str, str | dict], params: str | DataFrame | None = None) -> DataFrame:
    """SRC-GLOB: catalogue rows of the stems that match *every* named pattern.

    A glob is a pattern, or ``{"pattern": ..., "type": ...}``. Of several sources the last one with a file for
    a (stem, name) holds, within one the last by file name. SRC-PARAMS: files of ``params`` become dataset-wide rows.
    """
    files = reduce(DataFrame.unionByName, [listed(spark, s).withColumn("source", F.lit(i)) for i, s in enumerate(sources)])
    found = None
    for name, spec in globs.items():
        pattern, kind = (spec, None) if isinstance(spec, str) else (spec["pattern"], spec.get("type"))
        typed = F.lit(kind) if kind else infer_type(file_extension(F.col("file")), strict=True)
        own = files.withColumnRenamed("name", "file").withColumn("stem", extract_stem(F.col("file"), pattern))
        if "*" not in pattern:
            own = own.where(F.col("file") == pattern)
        own = own.where("stem IS NOT NULL").select("stem", F.lit(name).alias("name"), typed.alias("type"), file_extension(F.col("file")).alias("format"), "path", "source", "file")
        found = own if found is None else found.unionByName(own)
    last = Window.partitionBy("stem", "name").orderBy(F.desc("source"), F.desc("file"))
    one = found.withColumn("_r", F.row_number().over(last)).where("_r = 1")
    whole = one.withColumn("_n", F.count("*").over(Window.partitionBy("stem"))).where(F.col("_n") == len(globs))
    place = lambda p: F.to_json(F.struct(p.alias("dir")))
    rows = whole.select(F.lit(MODIFIED).alias("category"), "stem", F.array().cast("array<string>").alias("path"), "name", "type", "format", place(F.col("path")).alias("value"))
    if params:
        p = listed(spark, params)
        rows = rows.unionByName(p.select(F.lit(None).cast("string").alias("category"), F.lit(None).cast("string").alias("stem"), F.array().cast("array<string>").alias("path"), F.regexp_replace("name", r"\.[^.]*$", "").alias("name"), infer_type(file_extension(F.col("name"))).alias("type"), file_extension(F.col("name")).alias("format"), place(F.col("path")).alias("value")))
    return rows


def id_map(spark: SparkSession, mapping: dict[str, dict[str, int]]) -> DataFrame:
    """SRC-IDMAP: ``(class_id, scope, id)`` of a nested map class -> scope -> id, as :func:`fieldloom.plans.session.read_config` reads it."""
    rows = [(str(c), str(scope), int(i)) for c, scopes in (mapping or {}).items() for scope, i in scopes.items()]
    return spark.createDataFrame(rows, "class_id string, scope string, id int")


def with_ids(refs: DataFrame, ids: DataFrame, scope: str, name: str = "class_id") -> DataFrame:
    """``(stem, class_id, id)``: the id of every item's class within a scope; null where the map has none."""
    from fieldloom.operators.catalog import attr

    own = ids.where(F.col("scope") == scope).select("class_id", "id")  # a config of few rows
    return attr(refs, name).withColumnRenamed("value", "class_id").join(own, "class_id", "left").select("stem", "class_id", "id")


def read_images(spark: SparkSession, path: str, names: str | None = None) -> DataFrame:
    """SRC-IMG: ``(path, h, w, channels, data)`` of PNG, JPEG, BMP and TIFF files, channels in the order red, green, blue, alpha.

    ``path`` may be a glob, each match of which Spark lists in a task of its own; of a folder with many files, those called like the glob ``names`` are listed at once.
    """
    reader = spark.read.format("binaryFile")
    reader = reader if names is None else reader.option("pathGlobFilter", names)
    return decoded_images(reader.load(path).select("path", "content"), "path")


def read_segmaps(spark: SparkSession, path: str) -> DataFrame:
    """SRC-SEG: ``(path, h, w, channels, data)`` of image files that hold labels: the first channel of each."""
    return decoded_segmaps(spark.read.format("binaryFile").load(path).select("path", "content"), "path")


def decoded_segmaps(files: DataFrame, key: str) -> DataFrame:
    """Label maps of ``(key, content)`` rows of image bytes: the first channel where a file has several."""
    found = decoded_images(files, key)
    first = F.transform(F.sequence(F.lit(0), F.col("h") * F.col("w") - 1), lambda i: F.get("data", i * F.col("channels")))
    return found.withColumn("data", F.when(F.col("channels") > 1, first).otherwise(F.col("data"))).withColumn("channels", F.lit(1))


def decoded_images(files: DataFrame, key: str) -> DataFrame:
    """Rasters of ``(key, content)`` rows of image bytes; null contents are left out, formats that ``images`` can't read are an error."""
    kind = files.schema[key].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            out = [[] for _ in range(5)]
            for p, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = images.decode(data)
                for column, v in zip(out, (p, a.shape[0], a.shape[1], 1 if a.ndim == 2 else a.shape[2], a.ravel().astype(np.int32))):
                    column.append(v)
            kinds = [to_arrow_type(kind), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=[key, "h", "w", "channels", "data"])

    return files.where("content IS NOT NULL").select(key, "content").mapInArrow(run, f"`{key}` {kind.simpleString()}, h int, w int, channels int, data array<int>")


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """SRC-NPY: ``(path, shape, data)``."""
    return decoded_arrays(spark.read.format("binaryFile").load(path).select("path", "content"), "path")


def decoded_arrays(files: DataFrame, key: str) -> DataFrame:
    """Arrays of ``(key, content)`` rows of NPY bytes; null contents are left out."""
    kind = files.schema[key].dataType

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            keys, arrays = batch.column(0).to_pylist(), [codecs.npy_decode(d) for d in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, to_arrow_type(kind)), pa.array([list(a.shape) for a in arrays], pa.list_(pa.int64())), pa.array([a.ravel().astype(float) for a in arrays], pa.list_(pa.float64()))], names=[key, "shape", "data"])

    return files.where("content IS NOT NULL").select(key, "content").mapInArrow(run, f"`{key}` {kind.simpleString()}, shape array<bigint>, data array<double>")


#: Members of an embedding bundle (fixed values).
BUNDLE = ("pred_ids", "gt_ids", "paths", "embeddings")


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """SRC-EMB: ``(path, gt, pred, v)`` of NPZ bundles, one row per sample. A bundle that lacks a member is an error."""
    import io
    import zipfile

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = ["path", "gt", "pred", "v"]

    def run(batches):
        for batch in batches:
            for where, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with zipfile.ZipFile(io.BytesIO(data)) as z:
                    lacks = [m for m in BUNDLE if f"{m}.npy" not in z.namelist()]
                    if lacks:
                        raise KeyError(f"{where} lacks {lacks}")
                    pred, gt, paths, v = (codecs.npy_decode(z.read(f"{m}.npy")) for m in BUNDLE)
                for i in range(0, len(v), 1000):
                    part = slice(i, i + 1000)
                    columns = [pa.array([str(p) for p in paths[part]]), pa.array(gt[part].astype(np.int32)), pa.array(pred[part].astype(np.int32)), pa.array(list(v[part].astype(float)), pa.list_(pa.float64()))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    return files.mapInArrow(run, "path string, gt int, pred int, v array<double>")


def attr_text(content: Column) -> Column:
    """SRC-ATTR: a payload as text without white space around it."""
    return F.regexp_replace(content.cast("string"), r"^\s+|\s+$", "")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """SRC-ATTR: whole files as stripped text."""
    return spark.read.format("binaryFile").load(path).select("path", attr_text(F.col("content")).alias("value"))


def mask_files(spark: SparkSession, root: str, files: DataFrame | None = None) -> DataFrame:
    """SRC-MASKDIR: ``(stem, class_id, path)`` of ``root/<class>/*.png`` or ``root/*.png`` (class ``__unlabeled__``); ``files`` is a listing of the root."""
    files = listed(spark, root if files is None else files, recursive=True).where(F.lower("name").endswith(".png"))
    base = F.lit(root.rstrip("/").rpartition("/")[2])
    parent = F.regexp_extract("path", r"([^/]*)/[^/]*$", 1)
    return files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("stem"), F.when(parent == base, "__unlabeled__").otherwise(parent).alias("class_id"), "path")


def pick_accumulator(arrays: DataFrame) -> DataFrame:
    """SRC-ACC: of :func:`read_arrays` rows the one with the largest sum; it must be (H, W, B)."""
    total = F.aggregate("data", F.lit(0.0), lambda a, v: a + v)
    ok = F.when(F.size("shape") == 3, F.col("shape")).otherwise(F.raise_error(F.lit("an accumulator has the shape (H, W, B)")).cast("array<bigint>"))
    return arrays.withColumn("total", total).orderBy(F.desc("total"), "path").limit(1).withColumn("shape", ok)


def _tree(body: str) -> dict | None:
    """A sidecar's JSON object; None if it can't be read as one."""
    try:
        tree = json.loads(body)
    except ValueError:
        return None
    return tree if isinstance(tree, dict) else None


def load_store(spark: SparkSession, root: str) -> DataFrame:
    """SRC-META: catalogue rows from JSON sidecars ``root/.meta/dataset_meta.json`` and ``root/<category>/.meta/<stem>.json``.

    Sidecars that can't be parsed count as absent, and so do nodes that aren't objects; a root without any is an error.
    """
    found = []
    for glob in (f"{root}/.meta/*.json", f"{root}/*/.meta/*.json"):  # named in full: listings leave out names with a leading dot
        try:
            found.append(spark.read.format("binaryFile").load(glob))
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    if not found:
        raise FileNotFoundError(f"no sidecars in {root}")
    return sidecar_rows(reduce(DataFrame.unionByName, found).select("path", F.col("content").cast("string").alias("body")))


def sidecar_rows(files: DataFrame) -> DataFrame:
    """Catalogue rows of sidecars ``(path, body)``."""
    parsed = files.select(F.regexp_extract("path", r"([^/]*)/\.meta/[^/]*$", 1).alias("category"), F.regexp_replace(F.regexp_extract("path", FILE, 1), r"\.json$", "").alias("stem"), "body")
    kinds = [pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        for batch in batches:
            out = [[] for _ in kinds]
            for category, stem, body in zip(*(c.to_pylist() for c in batch.columns)):
                top, tree = stem == "dataset_meta", _tree(body)
                if tree is None:
                    continue
                todo = [([], tree.get("params", tree) if top else tree.get("info", tree))]
                while todo:
                    path, own = todo.pop()
                    for name, node in own.items() if isinstance(own, dict) else ():
                        if not isinstance(node, dict):
                            continue
                        info = node.get("info", {})
                        if node.get("type") == "stem":
                            todo.append(([*path, name], info))
                            continue
                        info = info if isinstance(info, dict) else {"value": info}
                        row = (None if top else category, None if top else stem, path, name, node.get("type"), node.get("format", ""), json.dumps(info["value"] if "value" in info else info, sort_keys=True))
                        for column, v in zip(out, row):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["category", "stem", "path", "name", "type", "format", "value"])

    return parsed.mapInArrow(run, SCHEMA)

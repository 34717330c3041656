"""Sinks: the catalogue as Parquet or JSON, bundles, routed outputs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.operators.catalog import gather


#: A store is a log of item versions: a row holds from its version on until its item has a newer one.
STORE = "category string, stem string, path array<string>, name string, type string, format string, value string, version long"
GONE = "deleted"


def scatter(refs: DataFrame, path: str) -> None:
    """SNK-SCATTER: the whole catalogue as version 0; what the store had before goes."""
    refs.withColumn("version", F.lit(0).cast("long")).write.mode("overwrite").parquet(path)


def _log(spark, path: str) -> DataFrame:
    return spark.read.schema(STORE).parquet(path)


def save_items(refs: DataFrame, path: str) -> None:
    """SNK-ITEM and SNK-TOP: the items and params in ``refs`` replace those of the store, whatever their category was.

    Only their rows are written, so an edit costs its own size; other items stay as they are. One writer at a time."""
    last = _log(refs.sparkSession, path).agg(F.max("version")).first()[0]
    refs.withColumn("version", F.lit((last or 0) + 1).cast("long")).write.mode("append").parquet(path)


def remove_items(stems: DataFrame, path: str) -> None:
    """CAT-DELETE in a store: items ``stems(stem)`` are gone from the next version on; unknown ones do no harm."""
    none = F.lit(None).cast("string")
    gone = stems.select("stem").distinct().select(none.alias("category"), F.col("stem").cast("string").alias("stem"), F.array().cast("array<string>").alias("path"), F.lit("").alias("name"), F.lit(GONE).alias("type"), none.alias("format"), none.alias("value"))
    save_items(gone, path)


def load(spark, path: str) -> DataFrame:
    """The newest version of each item, and of each param by its name."""
    log = _log(spark, path).withColumn("_key", F.coalesce(F.concat(F.lit("s"), "stem"), F.concat(F.lit("p"), "name")))
    newest = log.groupBy("_key").agg(F.max("version").alias("version"))
    return log.join(newest, ["_key", "version"]).where(F.col("type") != GONE).select("category", "stem", "path", "name", "type", "format", "value")


def compact(spark, path: str, target: str) -> None:
    """The newest versions as a store of their own."""
    scatter(load(spark, path), target)


def write_bundle(refs: DataFrame, path: str, categories: list[str] | None = None) -> None:
    """SNK-GATHER: JSON lines, one item each; the number of files follows the data."""
    gather(refs, categories).write.mode("overwrite").json(path)


def routed(table: DataFrame, name: str, to: str = "meta", level: str = "object", category: str = "modified", type_: str | None = None, format_: str | None = None, dir_: str | None = None) -> DataFrame:
    """SNK-ROUTE: catalogue rows of a step's output ``(stem[, obj_id], value)``.

    ``to: meta`` keeps it inline: a raster (with ``h`` and ``w``) as run lengths, anything else as an attribute.
    ``to: storage`` refers to a file: its type is given, or inferred from the format, or an image; the directory is the
    output's name unless given. Missing values give no row."""
    from fieldloom.functions.expressions import EXTENSIONS

    raster = {"h", "w"} <= set(table.columns)
    path = F.array(F.col("obj_id").cast("string")) if level == "object" else F.array().cast("array<string>")
    suffix = (format_ or "").lstrip(".")
    if to == "meta":
        kind, form = ("rle", "") if raster else ("attr", suffix or "str")
        value = _runs(F.col(name)) if raster else F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v"))), r'^\{"v":(.*)\}$', 1)
    else:
        kind = type_ or next((k for k, names in EXTENSIONS.items() if suffix.lower() in names), "image")
        form, value = suffix or {"image": "png", "array": "npy", "segmap": "png"}.get(kind, "str"), F.to_json(F.struct(F.lit(dir_ or name).alias("dir")))
    rows = table.where(F.col(name).isNotNull())
    return rows.select(F.lit(category).alias("category"), F.col("stem").cast("string").alias("stem"), path.alias("path"), F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(form).alias("format"), value.alias("value"))


def _runs(data):
    """``{"size": [h, w], "counts": [...]}`` of a row's raster, run lengths by column, the first of zeros."""
    h, w = F.col("h"), F.col("w")
    on = F.transform(F.sequence(F.lit(0), h * w - 1), lambda i: (F.get(data, ((i % h) * w + F.floor(i / h)).cast("int")) > 0).cast("int"))
    cuts = lambda o: F.concat(F.array(F.lit(0)), F.filter(F.sequence(F.lit(0), F.size(o) - 1), lambda i: F.get(o, i) != F.when(i == 0, 0).otherwise(F.get(o, i - 1))), F.array(F.size(o)))
    runs = lambda c: F.zip_with(F.slice(c, F.lit(2), F.size(c) - 1), F.slice(c, F.lit(1), F.size(c) - 1), lambda b, a: b - a)
    counts = F.element_at(F.transform(F.transform(F.array(on), cuts), runs), 1)
    return F.to_json(F.struct(F.array(h, w).alias("size"), counts.alias("counts")))


def replace_objects(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """SNK-OBJ: the object containers of the items in ``objects(catalogue rows)`` are replaced, leaves stay."""
    stems = objects.select("stem").distinct()
    kept = refs.join(stems.withColumn("_hit", F.lit(True)), "stem", "left").where("_hit IS NULL OR size(path) = 0").select(refs.columns)
    return kept.unionByName(objects.select(refs.columns))


def report(diagnosis: DataFrame) -> str:
    """SNK-REPORT: text of a diagnosis, a table of one row per channel."""
    lines = []
    for r in diagnosis.orderBy("channel").collect():
        lines.append(f"{r.channel}: mean {r.g_mean:.2f}, deviation {r.g_std:.2f}, vote mean {r.vote_mean:.2f}, spatial fraction {r.spatial_fraction:.3f}" + (", contaminated" if r.contaminated else ""))
    return "\n".join(lines)


def write_misdetections(result: DataFrame, means: DataFrame, path: str) -> None:
    """SNK-MISCSV: tables as CSV, and the class means ``(cls, j, m)`` as one NPZ file (classes x features numbers)."""
    import io

    import numpy as np

    result.write.mode("overwrite").option("header", "true").csv(f"{path}/misdetected")
    means.write.mode("overwrite").option("header", "true").csv(f"{path}/class_means")
    rows = means.groupBy("cls").agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("m")).orderBy("cls").collect()
    held = io.BytesIO()
    np.savez(held, ids=np.array([r.cls for r in rows]), means=np.array([[x.m for x in r.m] for r in rows]))
    write_bytes(result.sparkSession, f"{path}/class_means.npz", held.getvalue())


def write_bytes(spark, path: str, data: bytes) -> None:
    """One file from the driver, in any file system that Spark reaches."""
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(data)
    finally:
        out.close()


def encoded(raster: DataFrame, fmt: str = "png") -> DataFrame:
    """SNK-SAVE: ``(stem, content binary)`` of array-form rasters, as NPY or an image format; keep it as a table, or write files.

    ``channels``, where there is such a column, tells how many samples a pixel has."""
    import numpy as np
    import pyarrow as pa

    from fieldloom.functions import codecs, images

    fmt = fmt.lstrip(".").lower()
    encode = codecs.npy_encode if fmt == "npy" else lambda a: images.encode(a, fmt)
    several = ["channels"] if "channels" in raster.columns else []

    def run(batches):
        for batch in batches:
            shapes = zip(batch.column("h").to_pylist(), batch.column("w").to_pylist(), batch.column("channels").to_pylist() if several else [1] * len(batch))
            data = [encode(np.asarray(batch.column("data")[i].values).reshape((h, w) if c == 1 else (h, w, c))) for i, (h, w, c) in enumerate(shapes)]
            yield pa.RecordBatch.from_arrays([batch.column("stem"), pa.array(data, pa.binary())], names=["stem", "content"])

    kind = raster.schema["stem"].dataType.simpleString()
    return raster.select("stem", "h", "w", *several, "data").mapInArrow(run, f"stem {kind}, content binary")


def write_files(payloads: DataFrame, folder: str, fmt: str = "png") -> None:
    """SNK-SAVE: one file ``<stem>.<fmt>`` per row, in a folder that all executors reach."""
    write_at(payloads.select(F.concat(F.lit(f"{folder}/"), F.col("stem").cast("string"), F.lit("." + fmt.lstrip("."))).alias("file"), "content"), folder)


def write_at(payloads: DataFrame, root: str) -> None:
    """Files ``(file, content)`` at their places, all or none of them; ``root`` is in the same file system and holds them until all are written."""
    from . import files

    files.register(payloads.sparkSession)
    payloads.select("file", "content").write.format(files.PayloadSink.name()).mode("append").save(root)


def payload_path(root, category, stem, path, directory, name, fmt):
    """Where a payload lies: ``root/<category>/<dir>/<stem>[_<obj_id>].<fmt>``; a param's has no stem: ``root/<dir>/<name>.<fmt>``."""
    base = F.when(stem.isNull(), name).otherwise(F.concat_ws("_", stem, F.when(F.size(path) > 0, F.element_at(path, 1))))
    folder = F.when(directory == "", name).otherwise(directory)
    return F.concat(F.concat_ws("/", F.lit(root), F.when(stem.isNotNull(), category), folder, base), F.when(F.coalesce(fmt, F.lit("")) == "", "").otherwise(F.concat(F.lit("."), F.ltrim(fmt, F.lit(".")))))


def payloads(refs: DataFrame, root: str) -> DataFrame:
    """``(category, stem, name, file)`` of the leaves that are files."""
    place = F.get_json_object("value", "$.dir")
    return refs.where(place.isNotNull()).select("category", "stem", "name", payload_path(root, F.col("category"), F.col("stem"), F.col("path"), place, F.col("name"), F.col("format")).alias("file"))


def payload_moves(refs: DataFrame, stems: DataFrame, to: str, root: str) -> DataFrame:
    """CAT-MOVE: ``(source, target)`` of the payload files of items that change their category."""
    own = refs.join(stems.select("stem").distinct(), "stem", "left_semi").where(F.col("category") != to)
    place = F.get_json_object("value", "$.dir")
    at = lambda category: payload_path(root, category, F.col("stem"), F.col("path"), place, F.col("name"), F.col("format"))
    return own.where(place.isNotNull()).select(at(F.col("category")).alias("source"), at(F.lit(to)).alias("target"))


def move_items(refs: DataFrame, stems: DataFrame, to: str, root: str) -> DataFrame:
    """CAT-MOVE with payloads: files first, in folders that executors share, then the catalogue. Unknown items are a KeyError."""
    from fieldloom.operators.catalog import move

    unknown = stems.select("stem").join(refs.select("stem"), "stem", "left_anti").first()
    if unknown:
        raise KeyError(unknown.stem)
    move_files(payload_moves(refs, stems, to, root))
    return move(refs, stems, to)


def delete_items(refs: DataFrame, stems: DataFrame, root: str) -> DataFrame:
    """CAT-DELETE with payloads; unknown items are ignored."""
    from fieldloom.operators.catalog import delete

    delete_files(payloads(refs.join(stems.select("stem").distinct(), "stem", "left_semi"), root))
    return delete(refs, stems)


def move_files(moves: DataFrame) -> None:
    """Move ``(source, target)`` files; a source that is gone (moved by an earlier try, say) is left out."""
    _each(moves.select("source", "target"), _moved)


def delete_files(paths: DataFrame) -> None:
    """Delete ``(file)``; a file that is gone is no error."""
    _each(paths.select("file"), _deleted)


def copy_files(moves: DataFrame) -> None:
    """CAT-COPY: copy ``(source, target)`` files; the source stays, a missing one is an error."""
    _each(moves.select("source", "target"), _copied)


def _each(rows: DataFrame, act) -> None:
    """``act`` for each row, where the row is, in any file system that pyarrow reaches."""

    def run(own):
        for r in own:
            act(*r)

    rows.foreachPartition(run)


def _moved(source: str, target: str) -> None:
    from . import files

    store, at = files.located(source)
    if store.get_file_info(at).is_file:
        to = files.located(target)[1]
        store.create_dir(to.rpartition("/")[0], recursive=True)
        store.move(at, to)


def _deleted(path: str) -> None:
    from . import files

    store, at = files.located(path)
    if store.get_file_info(at).is_file:
        store.delete_file(at)


def _copied(source: str, target: str) -> None:
    from pyarrow import fs

    from . import files

    (store, at), (other, to) = files.located(source), files.located(target)
    other.create_dir(to.rpartition("/")[0], recursive=True)
    fs.copy_files(at, to, source_filesystem=store, destination_filesystem=other)

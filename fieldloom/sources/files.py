"""Files as Python data sources, so Spark plans their partitions and commits: ``fieldloom_lines`` reads annotations, ``fieldloom_payloads`` writes payloads.

Paths are folders or URIs that pyarrow reaches (``file:``, ``hdfs:``, ``s3:``, ...) from the driver and all executors.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from fieldloom.operators.catalog import MODIFIED, SCHEMA

#: Bytes of a file that one task reads.
SPLIT = 16 << 20
#: Bytes of files that a task holds before it hands them on.
HELD = 64 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path as Spark names it (unescaped), and the place in it."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(path)
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    store, _ = fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")
    host = "" if scheme == "hdfs" or scheme == "viewfs" else rest.lstrip("/").partition("/")[0] + "/"  # object stores name the bucket in the path
    return store, f"{host}{rest.lstrip('/').partition('/')[2]}" if host else "/" + rest.lstrip("/").partition("/")[2]


def contents(rows: DataFrame, path: str = "path") -> DataFrame:
    """``rows`` with the bytes of the file that each names, read where the row is, so no folder is listed; a missing file is an error. Rows without a path are left out."""

    def run(batches):
        for batch in batches:
            data = []
            for one in batch.column(path).to_pylist():
                store, at = located(one)
                with store.open_input_stream(at) as f:
                    data.append(f.read())
                if sum(map(len, data)) > HELD:  # files are handed on before many are held
                    yield with_bytes(batch, data)
                    batch, data = batch.slice(len(data)), []
            yield with_bytes(batch, data)

    def with_bytes(batch: pa.RecordBatch, data: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*batch.slice(0, len(data)).columns, pa.array(data, pa.binary())], names=[*batch.schema.names, "content"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.where(F.col(path).isNotNull()).mapInArrow(run, f"{fields}, content binary")


def register(spark: SparkSession) -> None:
    for source in (LineSource, PayloadSink):
        spark.dataSource.register(source)


# --- annotations, one item a line ------------------------------------------------------------------------------------


@dataclass
class Split(InputPartition):
    path: str
    start: int
    end: int


class LineSource(DataSource):
    """Catalogue rows of ``*.jsonl`` files: a line is an item,
    ``{"stem": ..., "leaves": {name: value}, "objects": [{"class_id": ..., "bbox": [x0, y0, x1, y1], "rle": {"size": ..., "counts": ...}}]}``.

    Options: ``path``; ``split``, bytes of a task; ``category`` of the items; ``torn``: ``fail`` (as is) or ``skip`` for lines that aren't such objects.
    """

    @classmethod
    def name(cls) -> str:
        return "fieldloom_lines"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LineReader(dict(self.options))


class LineReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = {k.lower(): v for k, v in options.items()}

    def partitions(self) -> list[Split]:
        store, root = located(self.options["path"])
        if store.get_file_info(root).type == fs.FileType.NotFound:
            raise FileNotFoundError(root)
        step = int(self.options.get("split", SPLIT))
        infos = [store.get_file_info(root)] if store.get_file_info(root).is_file else store.get_file_info(fs.FileSelector(root, recursive=True))
        files = sorted((i.path, i.size) for i in infos if i.is_file and (i.path.endswith((".jsonl", ".json")) or i.path == root) and not i.base_name.startswith((".", "_")))
        return [Split(path, a, min(a + step, size)) for path, size in files for a in range(0, size, step)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator[tuple]:
        if partition.path:
            store, _ = located(self.options["path"])
            with store.open_input_file(partition.path) as f:
                for at, line in lines_from(f, partition.start, partition.end):
                    try:
                        yield from item_rows(json.loads(line), self.options.get("category", MODIFIED))
                    except (ValueError, KeyError, TypeError, AttributeError) as bad:
                        if self.options.get("torn", "fail") != "skip":
                            raise ValueError(f"{partition.path}, byte {at}: not an item") from bad


def lines_from(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines that begin in ``[start, end)``, with their place; blank ones are left out."""
    at = max(0, start - 1)
    f.seek(at)
    held, skip = b"", start > 0  # the line that the byte before belongs to begins in another range
    while at < end or held:
        block = f.read(1 << 20)
        held += block
        while (cut := held.find(b"\n")) >= 0 or (not block and held):
            line, held = (held[:cut], held[cut + 1 :]) if cut >= 0 else (held, b"")
            place, at = at, at + len(line) + 1
            if not skip and place >= end:
                return
            if not skip and line.strip():
                yield place, line
            skip = False
        if not block:
            return


def item_rows(item: dict, category: str) -> Iterator[tuple]:
    """Catalogue rows of one item, at once or not at all."""
    stem, text = str(item["stem"]), lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"))
    rows = [(category, stem, [], str(k), "attr", "json" if isinstance(v, (dict, list)) else "str", text(v)) for k, v in (item.get("leaves") or {}).items()]
    for i, own in enumerate(item.get("objects") or []):
        for k, v in own.items():
            if k == "bbox":
                v = dict(zip(("x0", "y0", "x1", "y1"), v, strict=True))
            rows.append((category, stem, [str(i)], str(k), "rle" if k == "rle" else "attr", "" if k == "rle" else "str", text(v)))
    return iter(rows)


# --- payload files ---------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    """A task's staging folder; its manifest there says what goes where, so the driver holds no list of all files."""

    folder: str
    count: int


class PayloadSink(DataSource):
    """Files of ``(file string, content binary)`` rows. Tasks write into a staging folder under the option ``path``; when all are
    done the files are moved to their places, otherwise nothing of them remains. A null content fails the task."""

    @classmethod
    def name(cls) -> str:
        return "fieldloom_payloads"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return PayloadWriter(dict(self.options), [f.name for f in schema.fields])


class PayloadWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], names: list[str]) -> None:
        self.store_at = {k.lower(): v for k, v in options.items()}["path"]
        self.staging = f"{located(self.store_at)[1].rstrip('/')}/.staging-{uuid.uuid4().hex}"
        self.at = names.index("file"), names.index("content")

    def write(self, iterator: Iterator) -> Written:
        store, _ = located(self.store_at)
        folder, count = f"{self.staging}/{uuid.uuid4().hex}", 0  # of this attempt alone
        store.create_dir(folder, recursive=True)
        try:
            with store.open_output_stream(f"{folder}/manifest") as manifest:
                for row in iterator:
                    file, content = row[self.at[0]], row[self.at[1]]
                    if file is None or content is None:
                        raise ValueError(f"no content for {file}")
                    with store.open_output_stream(f"{folder}/{count}") as out:
                        out.write(bytes(content))
                    manifest.write(json.dumps(file).encode() + b"\n")
                    count += 1
        except BaseException:
            store.delete_dir(folder)
            raise
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        store, _ = located(self.store_at)
        made: set[str] = set()

        def place(job: tuple[str, str]) -> None:
            source, target = job
            parent = target.rpartition("/")[0]
            if parent not in made:
                store.create_dir(parent, recursive=True)
                made.add(parent)
            store.move(source, target)

        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is not None:
                    with store.open_input_stream(f"{m.folder}/manifest") as f:
                        targets = [located(json.loads(line))[1] for line in f.read().splitlines()]
                    list(pool.map(place, [(f"{m.folder}/{i}", t) for i, t in enumerate(targets)]))
        store.delete_dir(self.staging) if store.get_file_info(self.staging).type == fs.FileType.Directory else None

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = located(self.store_at)
        if store.get_file_info(self.staging).type == fs.FileType.Directory:
            store.delete_dir(self.staging)

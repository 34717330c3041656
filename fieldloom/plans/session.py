"""Sessions: a config of a converter and flows, run on a store.

A config is a nested map, or a YAML or JSON file of one (``converter`` may be a list, see ``sources.converters``)::

    dataset_root: /shared/data/survey
    converter: {sources: [...], globs: {frame: "*_view.png", ...}, params: folder, id_map: {...} or file}
    flows: [{name: ..., unit: frame, processes: [{object_type: detect_edge, low: 50, outputs: {...}}, ...]}, ...]

Steps name their operator by ``object_type`` or ``op``. :meth:`Session.convert` registers whole stems as modified
items; :meth:`Session.run` runs all flows over the modified items, each seeing what the ones before put out, and
saves the items once at the end. Files of rasters are written to folders that all executors share.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import catalog as C
from fieldloom.sources import converters as V
from fieldloom.sources import discover as S
from fieldloom.sources import files as P
from fieldloom.sources import sinks as K

from .flow import BOX, Flow, FlowResult, run_flows


def read_config(path: str) -> dict[str, Any]:
    """A YAML or JSON file; JSON alone where no YAML reader is installed."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        import yaml
    except ModuleNotFoundError:
        return json.loads(text)
    return yaml.safe_load(text) or {}


def flow_of(config: dict[str, Any]) -> Flow:
    """A flow from its config; unknown fields are a KeyError."""

    def step(spec):
        if isinstance(spec, str):
            return spec
        spec = dict(spec)
        kind = spec.pop("object_type", None) or spec.pop("op")
        spec["outputs"] = {k: dict(v or {}) for k, v in (spec.get("outputs") or {}).items()}
        return {"op": kind} | spec

    config = {k: v for k, v in config.items() if k != "object_type"}
    known = Flow.__dataclass_fields__
    if bad := [k for k in config if k not in known]:
        raise KeyError(f"unknown flow fields {bad}")
    for k in ("processes", "finalize_processes"):
        config[k] = [step(p) for p in config.get(k) or []]
    return Flow(**config)


def write_payloads(table: DataFrame, name: str, spec: dict, root: str) -> None:
    """The rasters of an output as files at their place in the store."""
    fmt, folder = (spec.get("format") or "png").lstrip("."), spec.get("dir") or name
    path = F.array(F.col("obj_id").cast("string")) if "obj_id" in table.columns else F.array().cast("array<string>")
    where = K.payload_path(root, F.lit(C.MODIFIED), F.col("stem"), path, F.lit(folder), F.lit(name), F.lit(fmt))
    K.write_at(K.encoded(table.where(F.col(name).isNotNull()).select(where.alias("stem"), "h", "w", F.col(name).alias("data")), fmt).withColumnRenamed("stem", "file"), root)


class Session:
    """All flows are built, and so checked, before anything runs."""

    def __init__(self, spark: SparkSession, config: dict[str, Any] | str) -> None:
        self.spark, self.config = spark, read_config(config) if isinstance(config, str) else config
        self.root = self.config["dataset_root"]
        self.store = f"{self.root}/store"
        self.flows = [flow_of(f) for f in self.config.get("flows") or []]
        V.checked(self.config.get("converter"))

    def ids(self) -> DataFrame:
        """SRC-IDMAP of the converters; of a class and scope in several maps the last holds."""
        merged: dict[str, dict[str, int]] = {}
        for _, own in V.checked(self.config.get("converter")):
            given = own.get("id_map") or {}
            for name, scopes in (read_config(given) if isinstance(given, str) else given).items():
                merged[name] = {**merged.get(name, {}), **scopes}
        return S.id_map(self.spark, merged)

    def refs(self) -> DataFrame | None:
        """The store's catalogue; None before there is one."""
        try:
            return K.load(self.spark, self.store)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def convert(self) -> int:
        """SRC-CONVERT: whole stems become modified items, in place of what the store had of them; how many (0: nothing matched)."""
        found = V.convert(self.spark, self.config["converter"]).persist()
        n = found.where("stem IS NOT NULL").select("stem").distinct().count()
        if n:
            (K.scatter if self.refs() is None else K.save_items)(found, self.store)
        found.unpersist()
        return n

    def frames(self, refs: DataFrame) -> DataFrame:
        """Modified items with their frame and their attributes as columns; each frame's file is read where its row is."""
        own = refs.where((F.col("category") == C.MODIFIED) & (F.size("path") == 0))
        place = own.where("name = 'frame'").select("stem", F.get_json_object("value", "$.dir").alias("path"))
        frames = S.decoded_images(P.contents(place), "stem").select("stem", F.lit(C.MODIFIED).alias("category"), "h", "w", F.col("data").alias("frame"))
        names = [r.name for r in own.where("type = 'attr' AND get_json_object(value, '$.dir') IS NULL").select("name").distinct().collect()]
        for name in names:
            frames = frames.join(C.attr(own, name).withColumnRenamed("value", name), "stem", "left")
        return frames

    def objects(self, refs: DataFrame) -> DataFrame | None:
        """Objects of modified items that have a box."""
        own = refs.where((F.col("category") == C.MODIFIED) & (F.size("path") == 1) & F.col("name").isin("bbox", "class_id"))
        value = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
        rows = own.groupBy("stem", F.element_at("path", 1).cast("int").alias("obj_id")).agg(value("class_id").alias("c"), value("bbox").alias("b")).where("obj_id IS NOT NULL AND b IS NOT NULL")
        if rows.isEmpty():
            return None
        return rows.select("stem", "obj_id", F.get_json_object(F.concat(F.lit('{"v":'), "c", F.lit("}")), "$.v").alias("class_id"), F.from_json("b", BOX).alias("bbox"))

    def rows_of(self, flow: Flow, result: FlowResult) -> DataFrame | None:
        """SNK-ROUTE: catalogue rows of a flow's declared outputs; rasters for storage are written."""
        out = None
        for _, outputs in flow.steps:
            for name, spec in outputs.items():
                if name not in result.tables:
                    continue
                table, to = result.tables[name], spec.get("to", "meta")
                if name == "object" and "obj_id" not in table.columns:
                    table = table.select("stem", F.posexplode("object").alias("obj_id", "o")).select("stem", "obj_id", "o.class_id", "o.bbox")
                    rows = K.routed(table, "class_id").unionByName(K.routed(table, "bbox"))
                else:
                    level = "object" if "obj_id" in table.columns else "frame"
                    rows = K.routed(table, name, to, level, C.MODIFIED, spec.get("type"), spec.get("format"), spec.get("dir"))
                    if to == "storage" and "h" in table.columns:
                        write_payloads(table, name, spec, self.root)
                out = rows if out is None else out.unionByName(rows)
        return out

    def run(self, params: dict[str, Any] | None = None, progress: Callable[[str, int, int], None] | None = None, keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> tuple[list[FlowResult], dict[str, Any]]:
        """All flows in order; then the items with what is new of them are saved as one version."""
        refs = self.refs()
        results, params = run_flows(self.flows, self.frames(refs), self.objects(refs), params, progress, keep)
        made = None
        for flow, result in zip(self.flows, results):
            rows = self.rows_of(flow, result)
            if rows is not None:
                made = rows if made is None else V.over(made, rows)
        if made is not None:
            own = refs.join(made.select("stem").distinct(), "stem", "left_semi").select(refs.columns)
            if not made.where("name = 'bbox'").isEmpty():
                own = own.where("size(path) = 0")  # new objects take the place of all old ones
            K.save_items(V.over(own, made), self.store)
        numbers = {k: v for k, v in params.items() if isinstance(v, (int, float))}
        if numbers:
            K.save_items(C.flatten(self.spark, {"params": {k: {"type": "attr", "info": {"value": v}} for k, v in numbers.items()}}), self.store)
        return results, params

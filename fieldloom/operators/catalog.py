"""The annotation catalogue as adjacency rows, and its operators.

``refs(category, stem, path array<string>, name, type, format, value)``: one row per leaf. ``category`` and
``stem`` are null for dataset-wide params. ``path`` holds the names of the containers between the item and the
leaf (an object's key, say). ``value`` is the payload of an inline leaf as JSON text, or the file's directory
as ``{"dir": ...}``. An item lives in one category, and that is its state.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MODIFIED, STAGED = "modified", "staged"
CATEGORIES = [MODIFIED, STAGED]
SCHEMA = "category string, stem string, path array<string>, name string, type string, format string, value string"
KEY = ["stem", "path", "name"]


def rank_of(category: str = "category"):
    """Fixed order of categories."""
    return F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col(category))


def leaves(refs: DataFrame) -> DataFrame:
    """CAT-LEAVES: ``(path, name, type, value)``; params have the path ()."""
    top = F.when(F.col("stem").isNull(), F.array().cast("array<string>")).otherwise(F.array("category", "stem"))
    return refs.where("type <> 'stem'").select(F.concat(top, F.coalesce("path", F.array().cast("array<string>"))).alias("path"), "name", "type", "value")


def items(refs: DataFrame, category: str | None = None) -> DataFrame:
    """CAT-ITER: items of one category, or of all in their fixed order."""
    own = refs.where("stem IS NOT NULL").select("category", "stem").distinct()
    return own.where(F.col("category") == category) if category else own


def find(refs: DataFrame, stem: str) -> DataFrame:
    """CAT-FIND: the leaves of an item and its state; the first category wins."""
    return refs.where(F.col("stem") == stem).withColumn("_r", F.min(rank_of()).over(Window.partitionBy("stem"))).where(rank_of() == F.col("_r")).drop("_r")


def variants(refs: DataFrame) -> DataFrame:
    """The catalogue with its values as VARIANT: numbers, lists and objects keep their types. Values that aren't JSON are null."""
    return refs.withColumn("value", F.try_parse_json("value"))


def attr(refs: DataFrame, name: str, default: str | None = None, kind: str = "string", path: str = "$") -> DataFrame:
    """CAT-ATTR: ``(stem, value)`` of an inline attribute of every item, or the default.

    ``kind`` is the type of the result (``variant`` leaves it as it is), ``path`` a place inside the value; a value that the
    type can't hold gives the default.
    """
    own = variants(refs.where((F.col("name") == name) & (F.size("path") == 0) & F.col("stem").isNotNull()).select("stem", "value"))
    own = own.select("stem", F.try_variant_get("value", path, kind).alias("value"))
    own = items(refs).select("stem").distinct().join(own, "stem", "left")
    if default is None:
        return own
    other = F.parse_json(F.lit(json.dumps(default))) if kind == "variant" else F.lit(default).cast(kind)
    return own.select("stem", F.coalesce("value", other).alias("value"))


def attr_kinds(refs: DataFrame) -> DataFrame:
    """``(name, kind, n)``: the types that the inline values of each attribute have."""
    own = variants(refs.where((F.col("type") == "attr") & F.get_json_object("value", "$.dir").isNull()))
    return own.groupBy("name", F.schema_of_variant("value").alias("kind")).agg(F.count("*").alias("n"))


def set_attr(refs: DataFrame, stem: str, name: str, value) -> DataFrame:
    """CAT-ATTR: create or update an attribute of an item."""
    home = items(refs).where(F.col("stem") == stem)
    made = home.select("category", "stem", F.array().cast("array<string>").alias("path"), F.lit(name).alias("name"), F.lit("attr").alias("type"), F.lit("str").alias("format"), F.lit(json.dumps(value)).alias("value"))
    return refs.where(~((F.coalesce("stem", F.lit("")) == stem) & (F.size("path") == 0) & (F.col("name") == name))).unionByName(made)


def move(refs: DataFrame, stems: DataFrame, to: str) -> DataFrame:
    """CAT-MOVE: the items ``stems(stem)`` get the category; unknown ones are an error of :func:`require`."""
    hit = refs.join(stems.select("stem", F.lit(True).alias("_hit")).distinct(), "stem", "left")
    return hit.withColumn("category", F.when(F.col("_hit"), to).otherwise(F.col("category"))).select(refs.columns)


def require(refs: DataFrame, stem: str) -> None:
    if find(refs, stem).isEmpty():
        raise KeyError(stem)


def delete(refs: DataFrame, stems: DataFrame) -> DataFrame:
    """CAT-DELETE: unknown items are ignored."""
    return refs.join(stems.select("stem"), "stem", "left_anti").select(refs.columns)


def conflicts(host: DataFrame, other: DataFrame) -> DataFrame:
    """CAT-CONFLICT: stems of ``other`` that the host has in any category."""
    return other.where("stem IS NOT NULL").select("stem").distinct().join(host.select("stem").distinct(), "stem", "left_semi")


def merge(host: DataFrame, other: DataFrame, override: bool = False) -> DataFrame:
    """CAT-MERGE.

    Items new to the host are added. With ``override`` items of ``other`` replace the host's, whatever their
    category. Without, an item in another category of the host stays as it is, and one in the same category
    gets the leaves that it lacks; no leaf goes below a name that is a leaf of the host, and containers merge.
    Params are added if missing, or overridden.
    """
    columns = host.columns
    hp, op = host.where("stem IS NULL"), other.where("stem IS NULL")
    keep, gain = (hp.join(op.select("name"), "name", "left_anti"), op) if override else (hp, op.join(hp.select("name"), "name", "left_anti"))
    params = keep.select(columns).unionByName(gain.select(columns))
    h, o = host.where("stem IS NOT NULL"), other.where("stem IS NOT NULL")
    if override:
        return params.unionByName(h.join(o.select("stem").distinct(), "stem", "left_anti").select(columns)).unionByName(o.select(columns))
    state = h.select("stem", F.col("category").alias("_home")).distinct()
    fits = o.join(state, "stem", "left").where("_home IS NULL OR _home = category").drop("_home")
    full = lambda df: df.withColumn("_full", F.concat("path", F.array("name")))
    own = h.select("stem", F.concat("path", F.array("name")).alias("_full"))
    # a host leaf stands at the new leaf's place or above it, or the host has a container there
    above = full(fits).withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.size("_full")), lambda n: F.slice("_full", F.lit(1), n))))
    blocked = above.join(own.withColumnRenamed("_full", "_up"), ["stem", "_up"], "left_semi").select("stem", "_full")
    inside = own.select("stem", F.explode(F.transform(F.sequence(F.lit(1), F.size("_full")), lambda n: F.slice("_full", F.lit(1), n))).alias("_full"))
    new = full(fits).join(blocked.union(inside).distinct(), ["stem", "_full"], "left_anti")
    return params.unionByName(h.select(columns)).unionByName(new.select(columns))


def stats(refs: DataFrame) -> DataFrame:
    """CAT-STATS: items by category, each with its number in the category."""
    return items(refs).withColumn("seq", F.row_number().over(Window.partitionBy("category").orderBy("stem")) - 1)


def not_in_state(refs: DataFrame, selection: DataFrame, to: str) -> DataFrame:
    """CAT-SUBSET: how many selected items aren't in the state yet."""
    return items(refs).join(selection.select("stem").distinct(), "stem", "left_semi").agg(F.count_if(F.col("category") != to).alias("n"))


def flatten(spark: SparkSession, store: dict) -> DataFrame:
    """CAT-SERIAL: rows of ``{"params": {...}, category: {stem: tree}}``; a tree maps names to leaves or containers."""
    rows: list[tuple] = []

    def walk(category, stem, path, tree):
        for name, node in tree.items():
            if isinstance(node, dict) and node.get("type") == "stem":
                walk(category, stem, [*path, name], node.get("info", {}))
            else:
                info = node.get("info", {})
                value = info["value"] if "value" in info else info
                rows.append((category, stem, path, name, node["type"], node.get("format", ""), json.dumps(value, sort_keys=True)))

    walk(None, None, [], store.get("params", {}))
    for category in CATEGORIES:
        for stem, tree in store.get(category, {}).items():
            walk(category, stem, [], tree.get("info", {}) if tree.get("type") == "stem" else tree)
    return spark.createDataFrame(rows, SCHEMA)


def nested(rows: list) -> dict:
    """CAT-SERIAL: the inverse of :func:`flatten` for the rows of a few items."""
    out: dict = {"params": {}, **{c: {} for c in CATEGORIES}}
    for r in rows:
        value = json.loads(r.value)
        info = value if isinstance(value, dict) and "dir" in value else {"value": value}
        node = {"type": r.type, "format": r.format, "info": info} if r.format else {"type": r.type, "info": info}
        if r.stem is None:
            out["params"][r.name] = node
            continue
        at = out[r.category].setdefault(r.stem, {"type": "stem", "info": {}})["info"]
        for name in r.path:
            at = at.setdefault(name, {"type": "stem", "info": {}})["info"]
        at[r.name] = node
    return out


def gather(refs: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """SNK-GATHER: one row per item, ``(category, stem, leaves)``, for a bundle; params come with null keys."""
    own = refs.where(F.col("category").isNull() | F.col("category").isin(categories or CATEGORIES))
    leaf = F.struct("path", "name", "type", "format", "value")
    return own.groupBy("category", "stem").agg(F.array_sort(F.collect_list(leaf)).alias("leaves"))

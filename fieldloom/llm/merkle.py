"""Merkle dataset manifest with coordinate lookup proofs.

Every row is a leaf of its group's tree, every run of 8 nodes makes a node of the next level, the groups' roots make a
tree of their own. The runs of all levels are a written table keyed by (group, level, run). A proof needs no walk: from a leaf's
place and the size of its group follow the coordinates of all runs on its way, which are exploded, joined with that
table, put in order, and concatenated or folded.

A run high in a tree is asked for by all leaves beneath it. So a lookup spans ``BAND`` levels at a time: leaves ask for
the lowest levels, the nodes above each for the next, and each takes over the way of the node that it ends at. No key
of a join has more than ``8 ** BAND`` rows, and the long upper part of a proof is looked up once for 64 leaves.

Null values count as "-". Equal rows are leaves of their own, in any order among themselves; rows of one id are ordered by their
digest, null ids come first. An empty table has no leaves and gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .ranges import AIM, numbered

FAN, BAND, BYTES = 8, 2, 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*values: Column) -> Column:
    """Lowercase hex sha256 of the values in a row, each with its length in bytes, or "-" where null."""
    told = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*told), 256)


def _joint(parts: Column) -> Column:
    """Digest, in bytes, of digests in bytes that stand one behind the other; they are hashed as hex text."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)), 256))


def leaves(docs: DataFrame, changed: Column | None = None, group: str = "lang", order: str = "doc_id", fields: tuple[str, ...] = FIELDS, text: str = "text") -> DataFrame:
    """``(key, id, leaf, claim)``: the digest of each row, and of the row with ``changed`` as its text where that isn't null."""
    leaf = digest(*[F.col(f) for f in fields])
    claim = F.when(changed.isNotNull(), digest(*[changed if f == text else F.col(f) for f in fields])) if changed is not None else F.lit(None).cast("string")
    key = F.coalesce(F.concat(F.lit("+"), F.col(group).cast("string")), F.lit(""))  # null first, then by bytes
    return docs.select(key.alias("key"), F.col(order).cast("long").alias("id"), F.unhex(leaf).alias("leaf"), F.unhex(claim).alias("claim"))


@dataclass
class Tree:
    """``levels[k]``: runs ``(key, level, run, n, kids, node)`` over the nodes of level k; ``roots (key, n, root)``; n: leaves of the key; ``total``: all leaves."""

    levels: list[DataFrame]
    roots: DataFrame
    total: int


def _files(rows: float) -> int:
    """Files of a table of at most so many rows: small tables are one file, whatever the number of partitions."""
    return 1 + int(rows // AIM)


def build(nodes: DataFrame, name: str) -> Tree:
    """All levels over ``(key, idx, n, node)``, one after the other, each an eighth of the one before and written once."""
    most, total = nodes.agg(F.coalesce(F.max("n"), F.lit(0)), F.count("*")).first()
    levels, roots = [], nodes.where("n = 1").select("key", "n", F.col("node").alias("root"))
    while most > FAN ** len(levels):
        k = len(levels)
        runs = nodes.where(F.col("n") > FAN**k).groupBy("key", F.expr(f"idx div {FAN}").alias("run")).agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("idx", "node"))).alias("kids"))
        runs = runs.withColumn("kids", F.aggregate("kids", F.lit(b""), lambda a, x: F.concat(a, x["node"])))
        runs = stored(runs.select("key", F.lit(k).alias("level"), "run", "n", "kids", _joint(F.col("kids")).alias("node")).coalesce(_files(total / FAN**k)), f"{name}-{k}")
        levels.append(runs)
        roots = roots.union(runs.where(F.col("n") <= FAN ** (k + 1)).select("key", "n", "node"))
        nodes = runs.select("key", F.col("run").alias("idx"), "n", "node")
    return Tree(levels, stored(roots.coalesce(_files(total)), f"{name}-roots"), total)


def _climb(nodes: DataFrame, runs: DataFrame, base: int) -> DataFrame:
    """``(key, up, idx, load, steps)`` of nodes ``(key, idx, n, load)`` of level ``base``: their siblings in the next ``BAND`` levels.

    ``up`` is the place of the node that the way ends at, ``steps`` has the bytes left and right of the way, lowest level first.
    """
    at = [F.when(F.col("n") > FAN ** (base + j), F.struct(F.lit(base + j).alias("level"), F.expr(f"idx div {FAN ** (j + 1)}").alias("run"), F.expr(f"idx div {FAN**j} % {FAN}").cast("int").alias("slot"))) for j in range(BAND)]
    asked = nodes.select("key", "idx", "load", F.explode_outer(F.array_compact(F.array(*at))).alias("at"))
    asked = asked.select("key", F.expr(f"idx div {FAN**BAND}").alias("up"), "idx", F.when(F.coalesce("at.level", F.lit(base)) == base, F.col("load")).alias("load"), "at.*")
    found = asked.join(runs.select("key", "level", "run", "kids"), ["key", "level", "run"], "left")
    left, right = F.expr(f"substring(kids, 1, slot * {BYTES})"), F.expr(f"substring(kids, slot * {BYTES} + {BYTES + 1})")
    found = found.select("key", "up", "idx", "load", F.when(F.col("kids").isNotNull(), F.struct("level", left.alias("left"), right.alias("right"))).alias("step"))
    # dealt by what the next join needs, which serves the grouping too
    ways = found.repartition("key", "up").groupBy("key", "up", "idx").agg(F.first("load", True).alias("load"), F.sort_array(F.collect_list("step")).alias("steps"))
    return ways.withColumn("steps", F.transform("steps", lambda s: F.struct(s["left"].alias("left"), s["right"].alias("right"))))


def prove(nodes: DataFrame, tree: Tree, tops: DataFrame, name: str) -> DataFrame:
    """``(key, load, steps, end)`` of ``nodes (key, idx, n, load)``: all siblings from the leaf to the end.

    ``tops (key, n, steps, end)`` says how each key goes on above its root.
    """
    spark, out, above = nodes.sparkSession, None, None
    for b in reversed(range(max(1, -(-len(tree.levels) // BAND)))):
        base = b * BAND
        ends = tops.where((F.col("n") > (FAN**base if b else 0)) & (F.col("n") <= FAN ** (base + BAND))).select("key", F.lit(0).cast("long").alias("up"), F.col("steps").alias("more"), "end")
        ends = ends if above is None else ends.union(above)
        runs = None
        for level in tree.levels[base : base + BAND]:
            runs = level if runs is None else runs.union(level)
        if runs is None:
            runs = spark.createDataFrame([], "key string, level int, run long, n long, kids binary, node binary")
        own = nodes if not b else tree.levels[base - 1].select("key", F.col("run").alias("idx"), "n", F.lit(True).alias("load"))
        out = _climb(own, runs, base).join(ends, ["key", "up"]).select("key", "idx", "load", F.concat("steps", "more").alias("steps"), "end")
        if b:
            above = stored(out.select("key", F.col("idx").alias("up"), F.col("steps").alias("more"), "end").coalesce(_files(tree.total / FAN**base)), f"{name}-ways-{b}")
    return out


def folded(leaf: Column, steps: Column) -> Column:
    """The root, in bytes, that follows from a leaf and the siblings on its way."""
    return F.aggregate(steps, leaf, lambda a, s: _joint(F.concat(s["left"], a, s["right"])))


def proof_digest(steps: Column) -> Column:
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.lower(F.hex(F.concat(s["left"], s["right"])))), ""), 256)


def proofs(docs: DataFrame, changed: Column | None = None, **names) -> DataFrame:
    """``(doc_id, leaf, subroot, root, steps, claim)`` of every row, digests in bytes; ``steps`` is the whole proof."""
    placed = stored(numbered(leaves(docs, changed, **names), "key", ["id", "leaf"]), "merkle-leaves")
    tree = build(placed.select("key", "idx", "n", F.col("leaf").alias("node")), "merkle")
    crown = numbered(tree.roots.select(F.lit("").alias("all"), F.col("key").alias("part"), F.col("n").alias("size"), "root"), "all", ["part"])
    crown = stored(crown.select(F.col("all").alias("key"), "idx", "n", "part", "size", "root").coalesce(_files(tree.total)), "merkle-crown")
    top = build(crown.select("key", "idx", "n", F.col("root").alias("node")), "merkle-top")
    nothing = F.array().cast("array<struct<left:binary,right:binary>>")
    ends = top.roots.select("key", "n", nothing.alias("steps"), F.col("root").alias("end"))
    ways = prove(crown.select("key", "idx", "n", F.struct("part", "size", "root").alias("load")), top, ends, "merkle-top")
    tops = stored(ways.select(F.col("load.part").alias("key"), F.col("load.size").alias("n"), "steps", F.struct(F.col("load.root").alias("subroot"), F.col("end").alias("root")).alias("end")).coalesce(_files(tree.total)), "merkle-tops")
    found = prove(placed.select("key", "idx", "n", F.struct("id", "leaf", "claim").alias("load")), tree, tops, "merkle")
    return found.select(F.col("load.id").alias("doc_id"), "load.leaf", "end.subroot", "end.root", "steps", "load.claim")


def manifest_report(docs: DataFrame) -> DataFrame:
    """Each row's proof, and the root that its claimed text leads to: rows where 3 divides crc32 of the id claim a text in lower case."""
    tampered = F.pmod(F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")), F.lit(3)) == 0
    rows = proofs(docs, F.when(tampered, F.translate("text", UPPER, LOWER)))
    text = lambda c: F.lower(F.hex(c))
    rows = rows.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"), text(folded(F.coalesce("claim", "leaf"), F.col("steps"))).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """Unsigned crc32 of an ASCII text in SQL, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda i: (ascii(c) >> i) & 1)))"
    step = "CASE WHEN (a & 1) <> b THEN xor(a >> 1, 3988292384) ELSE a >> 1 END"
    return f"xor(list_reduce({bits}, lambda a, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def oracle_sql() -> str:
    field = lambda v: f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"
    leaf = lambda t: "sha256(" + " || ".join(field(t if f == "text" else f) for f in FIELDS) + ")"
    changed = f"translate(text, '{UPPER}', '{LOWER}')"
    return f"""WITH RECURSIVE docs AS (SELECT doc_id, coalesce('+' || lang, '') AS grp, {leaf("text")} AS leaf, CASE WHEN {crc32_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 AND text IS NOT NULL THEN {leaf(changed)} END AS claim FROM documents),
leaves AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n FROM docs),
tree AS (SELECT grp, 0 AS level, idx, n, leaf AS h FROM leaves UNION ALL
 SELECT grp, max(level) + 1, idx // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY grp, idx // 8),
subs AS (SELECT grp, h, row_number() OVER (ORDER BY grp) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS level, idx, n, h FROM subs UNION ALL SELECT max(level) + 1, idx // 8, (max(n) + 7) // 8, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY idx // 8),
kids AS (SELECT grp, level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM tree WHERE n > 1 GROUP BY ALL), top_kids AS (SELECT level, idx // 8 AS run, list(h ORDER BY idx) AS hs FROM top WHERE n > 1 GROUP BY ALL),
ids AS (SELECT row_number() OVER () AS r, * FROM leaves),
steps AS (SELECT r, k.level AS level, hs, CAST(idx // CAST(8 ** k.level AS BIGINT) % 8 AS INT) AS slot FROM ids JOIN kids k ON k.grp = ids.grp AND k.run = idx // CAST(8 ** (k.level + 1) AS BIGINT)
 UNION ALL SELECT r, 100 + k.level, hs, CAST(s.idx // CAST(8 ** k.level AS BIGINT) % 8 AS INT) FROM ids JOIN subs s USING (grp) JOIN top_kids k ON k.run = s.idx // CAST(8 ** (k.level + 1) AS BIGINT)),
ways AS (SELECT r, row_number() OVER (PARTITION BY r ORDER BY level) AS p, array_to_string(hs[:slot], '') AS lft, array_to_string(hs[slot + 2:], '') AS rgt FROM steps),
proof AS (SELECT r, sha256(string_agg(lft || rgt, '' ORDER BY p)) AS proof_sha256 FROM ways GROUP BY r),
fold AS (SELECT r, CAST(0 AS BIGINT) AS p, coalesce(claim, leaf) AS h FROM ids UNION ALL SELECT f.r, f.p + 1, sha256(lft || h || rgt) FROM fold f JOIN ways w ON w.r = f.r AND w.p = f.p + 1),
ends AS (SELECT r, arg_max(h, p) AS folded_root FROM fold GROUP BY r)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = t.h AS verified
FROM ids JOIN (SELECT grp, h FROM subs) s USING (grp) JOIN (SELECT h FROM top WHERE n = 1) t ON true LEFT JOIN proof USING (r) JOIN ends USING (r)"""

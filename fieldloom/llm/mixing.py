"""Mixing sources to target weights by Pareto order sampling.

1. A source's size is the sum of its documents' words. Sources share ``share`` of all words by weight; none gets over ``most``
   times its size, what exceeds that is dealt to the others by weight until none is above.
2. Inside a source a document is worth copies in proportion to ``2 ** (k / 4)``, where ``2 ** k`` is the largest power of two in its
   size (long documents more often, gently), no more than ``most``, so that the expected words are the target.
3. The whole part of the expected copies is certain. The rest is the chance of one more copy: documents are ranked by their random
   odds divided by the odds of that chance (Pareto order sampling) and taken in this order as long as the words fit. The size
   of a sample, in words, is fixed by the target, not random.
4. What is then left of the target, less than the document at which the order stopped, is closed by up to ``CLOSING`` single
   documents of the size nearest to it.

Random numbers are digests of the id (of the text where the id is null), so runs agree, whatever the partitioning. Rows of one id and
source in equal sizes are interchangeable. Null texts and texts without words have size 0 and are taken with 0 words; a null
source is a source. No row is collected: the order runs in ranges (``ranges.numbered``), so one source may hold any share of
the rows, and totals come from partial aggregates. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .ranges import numbered

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, MOST, CLOSING = (5, 2, 1), 1.5, 2, 3
#: Worth of a document by the power of two in its size, as whole numbers, so that sums are exact.
TILT = tuple(round(1024 * 2 ** (k / 4)) for k in range(63))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: Column) -> Column:
    """A number above 0 and below 1 from 52 bits of a digest."""
    return (F.conv(F.substring(F.sha2(seed, 256), 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 0) -> DataFrame:
    """``(doc_id, key, size, u)``; keys ascend as sources by bytes, null last."""
    key = F.coalesce(F.concat(F.lit("0"), F.col(source_col).cast("string")), F.lit("1"))
    of = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.concat(F.lit("-"), F.coalesce(text_col, F.lit("")))))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), key.alias("key"), word_count(F.col(text_col)).alias("size"), uniform(of).alias("u"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``(key, source_size, target)`` of ``(key, source_size)``, one row for each source.

    The level to which weights are filled is found by rounds of one aggregate each; only its sums reach the driver.
    """
    placed = numbered(sources.withColumn("all", F.lit("")), "all", ["key"])
    placed = stored(placed.select("key", "source_size", F.get(F.array(*[F.lit(w) for w in weights]), F.col("idx") % len(weights)).cast("long").alias("weight")), "mix-sources")
    limit = F.col("source_size") * most
    total = share * int(placed.agg(F.sum(F.col("source_size").cast("decimal(38,0)"))).first()[0] or 0)
    level = 0.0
    while True:
        above = limit < F.col("weight") * F.lit(level)
        full, free = placed.agg(F.sum(F.when(above, limit).cast("decimal(38,0)")), F.sum(F.when(~above, F.col("weight")))).first()
        if not free:
            break
        higher = (total - int(full or 0)) / int(free)
        if higher <= level:
            break
        level = higher
    return placed.select("key", "source_size", F.least(limit.cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def _worth(k: Column) -> Column:
    return F.get(F.array(*[F.lit(t) for t in TILT]), k).cast("long")


def shares(docs: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """``(key, k, source_size, target, whole, chance, rest)``: certain copies and chance of one more for each power of two of each source.

    ``rest`` is what the target leaves to the sample. A source has at most 63 rows, so its windows are small.
    """
    own = docs.groupBy("key", "k").agg(F.sum("size").alias("words")).join(sources, "key").withColumn("worth", F.when(F.col("k") >= 0, _worth(F.greatest("k", F.lit(0)))).otherwise(0))
    down = Window.partitionBy("key").orderBy(F.desc("k"))
    full = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    free = F.sum((F.col("words").cast("decimal(38,0)") * F.col("worth")).cast("decimal(38,0)")).over(down.rowsBetween(0, Window.unboundedFollowing))
    rate = (F.col("target") - full * most) / F.when(free > 0, free.cast("double"))
    own = own.withColumn("rate", rate).withColumn("rate", F.when(F.col("rate") * F.col("worth") <= most, F.col("rate")))
    whole_key = Window.partitionBy("key")
    rate = F.max_by("rate", F.when(F.col("rate").isNotNull(), F.col("k"))).over(whole_key)
    own = own.withColumn("rate", rate).withColumn("copies", F.when(F.col("rate").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.round(F.col("rate") * F.col("worth"), 9))))
    own = own.withColumn("whole", F.floor("copies")).withColumn("chance", F.col("copies") - F.col("whole"))
    return own.select("key", "k", "source_size", "target", "whole", "chance", (F.col("target") - F.sum(F.col("whole") * F.col("words")).over(whole_key)).alias("rest"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST, **names) -> DataFrame:
    """``(doc_id, size, source_size, target, taken)``, a row for each row of ``docs``."""
    rows = stored(sized(docs, **names), "mix-sizes").withColumn("k", (F.length(F.bin("size")) - 1).cast("int"))
    rows = rows.withColumn("k", F.when(F.col("size") > 0, F.col("k")).otherwise(-1))
    sources = stored(rows.groupBy("key").agg(F.sum("size").alias("source_size")), "mix-words")
    table = stored(shares(rows, targets(sources, weights, share, most), most), "mix-shares")
    rows = rows.join(table, ["key", "k"])
    certain = rows.where("chance = 0 OR size = 0").select("doc_id", "size", "source_size", "target", (F.col("whole") * F.col("size")).alias("taken"))
    odds = lambda p: F.col(p) / (1 - F.col(p))
    drawn = rows.where("chance > 0 AND size > 0").select("doc_id", "key", "size", "source_size", "target", "whole", "rest", (odds("u") / odds("chance")).alias("rank"))
    drawn = stored(numbered(drawn, "key", ["rank", "doc_id", "size"], "size").drop("n"), "mix-order")
    fits = F.col("upto") <= F.col("rest")
    left = drawn.groupBy("key").agg((F.max("rest") - F.sum(F.when(fits, F.col("size")).otherwise(0))).alias("left"))
    extra = None
    for _ in range(CLOSING):
        # one partial aggregate: the document whose size is nearest to what is left
        free = drawn.where(~fits).select("key", "idx", "size")
        if extra is not None:
            free = free.join(extra.select("key", "idx"), ["key", "idx"], "left_anti")
        near = F.struct(F.abs(F.col("size") - F.col("left")).alias("off"), "idx", "size")
        best = free.join(left, "key").where(F.col("size") < 2 * F.col("left")).groupBy("key").agg(F.min(near).alias("b")).select("key", "b.idx", "b.size")
        best = stored(best, "mix-closing")
        left = stored(left.join(best.select("key", "size"), "key", "left").select("key", (F.col("left") - F.coalesce("size", F.lit(0))).alias("left")), "mix-left")
        extra = best if extra is None else extra.union(best)
    drawn = drawn.join(extra.select("key", "idx", F.lit(1).alias("one")), ["key", "idx"], "left")
    copies = F.col("whole") + F.when(fits | F.col("one").isNotNull(), 1).otherwise(0)
    return certain.union(drawn.select("doc_id", "size", "source_size", "target", copies * F.col("size")))


def oracle_sql() -> str:
    word = WORD.replace("'", "''")
    closing = ""
    for i in range(1, CLOSING + 1):
        closing += f""", p{i} AS (SELECT key, min((abs(size - lft), idx, size)) AS b FROM u{i - 1} JOIN l{i - 1} USING (key) WHERE size < 2 * lft GROUP BY key),
u{i} AS (SELECT u.* FROM u{i - 1} u LEFT JOIN p{i} p ON p.key = u.key AND p.b[2] = u.idx WHERE p.key IS NULL),
l{i} AS (SELECT key, lft - coalesce(b[3], 0) AS lft FROM l{i - 1} LEFT JOIN p{i} USING (key))"""
    picked = " UNION ALL ".join(f"SELECT key, b[2] AS idx FROM p{i}" for i in range(1, CLOSING + 1))
    return f"""WITH d AS (SELECT doc_id, coalesce('0' || source, '1') AS key, coalesce(len(regexp_extract_all(text, '{word}')), 0) AS size,
 (CAST('0x' || substr(sha256('0:' || coalesce(CAST(doc_id AS VARCHAR), '-' || coalesce(text, ''))), 1, 13) AS BIGINT) + 0.5::DOUBLE) / {1 << 52}::DOUBLE AS u FROM documents),
s AS (SELECT key, sum(size) AS ssize, [{", ".join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY key) - 1) % {len(WEIGHTS)}] AS w FROM d GROUP BY key),
o AS (SELECT *, {SHARE} * sum(ssize) OVER () AS total, coalesce(sum({MOST} * ssize) OVER (ORDER BY {MOST} * ssize / w, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped, sum(w) OVER (ORDER BY {MOST} * ssize / w, key ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free FROM s),
c AS (SELECT max((CAST(total AS DOUBLE) - CAST(capped AS DOUBLE)) / CAST(free AS DOUBLE)) FILTER ((CAST(total AS DOUBLE) - CAST(capped AS DOUBLE)) / CAST(free AS DOUBLE) * w <= {MOST} * ssize) AS level FROM o),
t AS (SELECT key, ssize, least(CAST({MOST} * ssize AS DOUBLE), w * level) AS target FROM s, c),
e AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) - 1 ELSE -1 END AS k FROM d),
g AS (SELECT key, k, sum(size) AS words, CASE WHEN k >= 0 THEN [{", ".join(map(str, TILT))}][k + 1] ELSE 0 END AS worth FROM e GROUP BY key, k),
r AS (SELECT g.*, ssize, target, (target - {MOST} * CAST(coalesce(sum(words) OVER (PARTITION BY key ORDER BY k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)) / nullif(CAST(sum(words * worth) OVER (PARTITION BY key ORDER BY k DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE), 0) AS rate FROM g JOIN t USING (key)),
q AS (SELECT *, arg_max(rate, k) FILTER (rate * worth <= {MOST}) OVER (PARTITION BY key) AS fixed FROM r),
f AS (SELECT *, CASE WHEN fixed IS NULL THEN {MOST}::DOUBLE ELSE least({MOST}::DOUBLE, round(fixed * worth, 9)) END AS copies FROM q),
h AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS chance, target - sum(floor(copies) * words) OVER (PARTITION BY key) AS rest FROM f),
x AS (SELECT e.*, ssize, target, whole, chance, rest FROM e JOIN h USING (key, k)),
n AS (SELECT *, (u / (1 - u)) / (chance / (1 - chance)) AS rank FROM x WHERE chance > 0 AND size > 0),
m AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY rank, doc_id NULLS FIRST, size) - 1 AS idx, sum(size) OVER (PARTITION BY key ORDER BY rank, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS upto FROM n),
u0 AS (SELECT key, idx, size FROM m WHERE upto > rest), l0 AS (SELECT key, max(rest) - coalesce(sum(size) FILTER (upto <= rest), 0) AS lft FROM m GROUP BY key){closing},
picked AS ({picked})
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(ssize AS BIGINT) AS source_size, target, CAST(whole * size AS BIGINT) AS taken FROM x WHERE chance = 0 OR size = 0
UNION ALL SELECT doc_id, CAST(size AS BIGINT), CAST(ssize AS BIGINT), target, CAST((whole + CASE WHEN upto <= rest OR p.idx IS NOT NULL THEN 1 ELSE 0 END) * size AS BIGINT) FROM m LEFT JOIN picked p ON p.key = m.key AND p.idx = m.idx"""

"""SimHash fingerprints in plain DataFrame functions.

The terms of a text are its pairs of neighbouring words (words are cut at white space and compared in lower
case; a text of one word has that word). Each occurrence of a term votes on 128 signed bits with its hash, so the
count of a term in its text weighs, times a weight from 1 to 4 by the rarity of the rarer of its words over all
documents (:func:`rarity`). The fingerprint has the bits with positive votes.

Texts stand in rows with a key that the rows are already dealt by, so their terms are exploded and added up
where they are, without a shuffle. Votes are counted in packed form, four 16-bit counters to a long for
``BLOCK`` terms at a time, and the blocks' counts are then added up, so texts of any length are counted whole.
Equal texts have equal fingerprints. Null and empty texts have no terms and the fingerprint 0.

:func:`near` finds all fingerprints within a Hamming radius by block tables: of ``radius + 1`` blocks at least
one is equal, so each fingerprint is listed once under each of its blocks, permuted to the front as the key.
Equal fingerprints are first counted as one, so copies never meet each other.

One changed word moves about 5 bits, so near copies lie farther apart than block tables reach. :func:`similar` finds
those within ``WIDE`` bits among texts that share a band of ``BAND`` least term hashes, of ``BANDS`` bands; texts with
a share of 0.9 of their word pairs share one with a chance of 0.9996, with 0.8 of 0.986.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, text_rows

#: Words are counted in so many cells over all documents.
CELLS = 1 << 16
#: A word has a weight more for each of these shares of all words that its cell stays below.
SHARES = (2.0**-9, 2.0**-12, 2.0**-15)
#: Weights are 4 at most, so a block's counters stay under 2 ** 15.
BLOCK = 8_000
_LANES = 0x0001000100010001
#: Near copies (five-word Jaccard of 0.8 and more) are within so many of 128 bits.
WIDE = 20
BANDS, BAND = 6, 3
_SALTS = [(0x9E3779B97F4A7C15 * (2 * i + 1) >> 7) & 0x7FFFFFFF for i in range(BANDS * BAND)]


def _shift(c: Column, n: int) -> Column:
    return F.shiftrightunsigned(c, n) if n else c


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(F.coalesce(text, F.lit(""))), "\t\n\x0b\f\r", "     "), " "), "")


def _cell(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(CELLS - 1)).cast("int")


def rarity(rows: DataFrame, text_col: str = "text") -> str:
    """Weights of all cells of words, one digit each, from the words of all texts; a table of fixed size.

    It depends on shares of the whole only, so it is alike at every size of the input."""
    words = rows.select(F.explode(_words(F.col(text_col))).alias("w")).groupBy(_cell(F.col("w")).alias("cell")).agg(F.count("*").alias("n"))
    n = {r.cell: r.n for r in words.collect()}  # ``CELLS`` rows at most
    total = max(1, sum(n.values()))
    return "".join(str(1 + sum(n.get(c, 0) / total < s for s in SHARES)) for c in range(CELLS))


def fingerprinted(rows: DataFrame, keys: list[str], texts: list[str], weights: str) -> DataFrame:
    """``keys``, a ``struct<a, b>`` per text column and the ``bands`` of the first. The keys tell rows apart; rows must be dealt by some of them."""
    rows = rows.select(*keys, F.posexplode(F.array(*[_words(F.col(t)) for t in texts])).alias("which", "words"))
    own = F.split(F.lit(",".join(weights)), ",").cast("array<int>")
    following = F.slice("words", F.lit(2), F.greatest(F.size("words") - 1, F.lit(0)))
    pairs = rows.select(*keys, "which", F.posexplode_outer(F.arrays_zip(F.col("words").alias("x"), following.alias("y"))).alias("pos", "p"))
    x, y = F.col("p.x"), F.col("p.y")
    # the last word has no follower: it is a term only if it is alone
    term = pairs.where(y.isNotNull() | (F.coalesce("pos", F.lit(0)) == 0))
    weight = F.when(x.isNull(), 0).otherwise(F.greatest(F.get(own, _cell(x)), F.get(own, _cell(y)))).cast("long")
    term = term.select(*keys, "which", F.expr(f"coalesce(pos, 0) div {BLOCK}").alias("block"), F.xxhash64(x, y).alias("a"), F.xxhash64(y, x, F.lit(1)).alias("b"), weight.alias("w"))
    names = [(word, j) for word in "ab" for j in range(16)]
    # other bits of the hash for each, so that one is no function of another
    least = [F.min(F.shiftright(F.col("ab"[i % 2]), 2 * (i // 2)).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").bitwiseXOR(F.lit(salt))).alias(f"m{i}") for i, salt in enumerate(_SALTS)]
    packed = term.groupBy(*keys, "which", "block").agg(*[F.sum(_shift(F.col(word), j).bitwiseAND(F.lit(_LANES)) * F.col("w")).alias(f"{word}{j}") for word, j in names], F.sum("w").alias("w"), *least)
    # counter of bit j + 16 * lane
    counts = [(f"{word}_{j + 16 * lane}", _shift(F.col(f"{word}{j}"), 16 * lane).bitwiseAND(F.lit(0xFFFF))) for word, j in names for lane in range(4)]
    summed = packed.groupBy(*keys, "which").agg(*[F.sum(c).alias(n) for n, c in counts], F.sum("w").alias("w"), *[F.min(f"m{i}").alias(f"m{i}") for i in range(len(_SALTS))])

    def word(name: str) -> Column:
        bits = [F.when(F.col(f"{name}_{bit}") * 2 > F.col("w"), F.lit((1 << bit) - (1 << 64 if bit == 63 else 0))).otherwise(0).cast("long") for bit in range(64)]
        while len(bits) > 1:
            bits = [p.bitwiseOR(q) for p, q in zip(bits[::2], bits[1::2])]
        return bits[0]

    prints = summed.select(*keys, "which", F.struct(word("a").alias("a"), word("b").alias("b")).alias("f"), F.when(F.col("which") == 0, F.array(*[F.xxhash64(F.lit(i), *[f"m{i * BAND + j}" for j in range(BAND)]) for i in range(BANDS)])).alias("bands"))
    return prints.groupBy(*keys).agg(*[F.max(F.when(F.col("which") == i, F.col("f"))).alias(t) for i, t in enumerate(texts)], F.max("bands").alias("bands"))


def to_hex(f: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(f["a"]), 16, "0"), F.lpad(F.hex(f["b"]), 16, "0")))


def distance(x: Column, y: Column) -> Column:
    return F.bit_count(x["a"].bitwiseXOR(y["a"])) + F.bit_count(x["b"].bitwiseXOR(y["b"]))


def likeness(x: Column, y: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(x, y) / F.lit(128.0)


def _edges(radius: int) -> list[tuple[int, int]]:
    """Bit ranges of ``radius + 1`` blocks of the 128 bits, from the highest of ``a`` on."""
    n = radius + 1
    at = [128 * i // n for i in range(n + 1)]
    return list(zip(at, at[1:]))


def _block(a: Column, b: Column, first: int, last: int) -> Column:
    """Bits ``first`` to ``last`` of two words as one long; blocks have 64 bits at most."""

    def part(w: Column, x: int, y: int) -> Column:
        return _shift(w if y - x == 64 else w.bitwiseAND(F.lit((1 << 64 - x) - 1).cast("long") if x else F.lit(-1).cast("long")), 64 - y)

    if last <= 64:
        return part(a, first, last)
    if first >= 64:
        return part(b, first - 64, last - 64)
    return F.shiftleft(part(a, first, 64), last - 64).bitwiseOR(part(b, 0, last - 64))


def near(prints: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """``(fingerprint, n_near)``: for each distinct query fingerprint, the rows of ``prints`` within the radius."""
    edges = _edges(radius)

    def tables(df: DataFrame, to: str) -> DataFrame:
        a, b = F.col("fingerprint.a"), F.col("fingerprint.b")
        listed = df.select(a.alias(f"{to}a"), b.alias(f"{to}b"), *[c for c in df.columns if c != "fingerprint"], F.array(*[_block(a, b, *e) for e in edges]).alias("blocks"))
        return listed.select("*", F.posexplode("blocks").alias("table", "key")).drop("blocks")

    counted = prints.groupBy("fingerprint").agg(F.count("*").alias("rows"))
    x, y = tables(queries.select("fingerprint").distinct(), "x"), tables(counted, "y")
    # a pair counts in the first table in which it meets
    a, b = F.col("xa").bitwiseXOR(F.col("ya")), F.col("xb").bitwiseXOR(F.col("yb"))
    first = F.when(_block(a, b, *edges[0]) == 0, 0)
    for i, e in enumerate(edges[1:], 1):
        first = first.when(_block(a, b, *e) == 0, i)
    met = x.join(y, ["table", "key"]).where((F.col("table") == first) & (F.bit_count(a) + F.bit_count(b) <= radius))
    return met.groupBy(F.struct(F.col("xa").alias("a"), F.col("xb").alias("b")).alias("fingerprint")).agg(F.sum("rows").alias("n_near"))


def similar(prints: DataFrame, queries: DataFrame, radius: int = WIDE) -> DataFrame:
    """``(fingerprint, bands, n_similar, similar_id)``: for each distinct query, how many rows of ``prints`` that share a
    band lie within the radius (its own among them), and the least id of these as the id of their class.

    Equal queries and equal rows are counted as one, as in :func:`near`. Only ids and fingerprints of the queries and of
    what they meet are dealt by band; a pair that meets in several bands is counted once."""

    def listed(df: DataFrame, to: str) -> DataFrame:
        return df.select(F.col("fingerprint.a").alias(f"{to}a"), F.col("fingerprint.b").alias(f"{to}b"), F.col("bands").alias(f"{to}_bands"), *[c for c in df.columns if c not in ("fingerprint", "bands")], F.posexplode("bands").alias("at", "band"))

    x = listed(queries.select("fingerprint", "bands").distinct(), "x")
    y = listed(prints.groupBy("fingerprint", "bands").agg(F.count("*").alias("rows"), F.min("doc_id").alias("least")), "y")
    close = F.bit_count(F.col("xa").bitwiseXOR(F.col("ya"))) + F.bit_count(F.col("xb").bitwiseXOR(F.col("yb"))) <= radius
    # a pair counts in the first band that it shares
    first = F.lit(None).cast("int")
    for i in reversed(range(BANDS)):
        first = F.when(F.col("x_bands")[i] == F.col("y_bands")[i], i).otherwise(first)
    met = x.join(y, ["at", "band"]).where(close & (F.col("at") == first))
    sums = met.groupBy("xa", "xb", "x_bands").agg(F.sum("rows").alias("n_similar"), F.min("least").alias("similar_id"))
    return sums.select(F.struct(F.col("xa").alias("a"), F.col("xb").alias("b")).alias("x_fingerprint"), "x_bands", "n_similar", "similar_id")


def _below(bounds: list[int], value: Column, equal: bool) -> Column:
    """How many of the sorted bounds are below the value (or equal to it): a binary search in a literal array."""
    held = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def step(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        own = F.get(held, mid)
        right = (acc["lo"] < acc["hi"]) & (own <= value if equal else own < value)
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(F.least(mid, acc["hi"])).alias("hi"))

    steps = F.array(*[F.lit(0)] * (len(bounds).bit_length() + 1))
    return F.aggregate(steps, start, step)["lo"]


def id_bounds(rows: DataFrame, id_col: str, per_range: int = 4_000, most: int = 16_383) -> list[int]:
    """Quantiles of the id that cut the rows into ranges of about ``per_range``, ``most`` at most."""
    n = rows.where(F.col(id_col).isNotNull()).count()
    cuts = min(most, n // per_range)
    if not cuts:
        return []
    return sorted(rows.agg(F.percentile_approx(id_col, [(i + 1) / (cuts + 1) for i in range(cuts)], 100 * (cuts + 1))).first()[0])


def with_next(rows: DataFrame, id_col: str, value_col: str, tie: Column, bounds: list[int]) -> DataFrame:
    """Adds ``range`` and ``place``, which tell rows apart and which they are dealt by, and ``next_value``: ``value_col`` of the next row by descending id (ties by ``tie``, a hash of the value, also descending; null ids last), the last row's being the first row's.

    Rows are dealt into ranges between quantiles of the id, so no task sees all of them, whatever the ids; the rows of
    an id that is several quantiles, and those without an id, are dealt further by ``tie``. The first row of each range is also sent to the range
    before it; the table of ranges that is broadcast has twice as many rows as ``bounds``, and two, at most.
    """
    share = tie / F.lit(2.0**64) + F.lit(0.5)
    below, upto = (_below(bounds, F.col(id_col), e) if bounds else F.lit(0) for e in (False, True))
    among = lambda lo, hi: lo + F.least(F.floor(share * (hi - lo + 1)).cast("int"), hi - lo)
    cuts = len(bounds)
    bucket = F.when(F.col(id_col).isNull(), among(F.lit(-cuts - 1), F.lit(-1))).otherwise(among(F.col("_below"), F.col("_upto"))).cast("long")
    dealt = rows.withColumn("_below", below).withColumn("_upto", upto).withColumn("_bucket", bucket).drop("_below", "_upto")
    order = [F.desc_nulls_last(id_col), tie.desc()]
    home = dealt.select("_bucket").distinct()
    tops = Window.orderBy(F.desc("_bucket"))  # over the few ranges
    home = home.withColumn("_home", F.coalesce(F.lag("_bucket").over(tops), F.min("_bucket").over(Window.partitionBy())))
    # the first row of a range by its order: the largest (id, tie); equal ones are alike
    key = F.struct(F.col(id_col).alias("i"), tie.alias("t"))
    heads = dealt.groupBy("_bucket").agg(F.max(key).alias("_head")).join(F.broadcast(home), "_bucket")
    both = dealt.join(F.broadcast(heads), "_bucket", "left")
    own = F.struct(F.col("_bucket").alias("to"), F.lit(False).alias("copy"))
    copy = F.struct(F.col("_home").alias("to"), F.lit(True).alias("copy"))
    sent = both.withColumn("_at", F.explode(F.when(key.eqNullSafe(F.col("_head")), F.array(own, copy)).otherwise(F.array(own))))
    # named once: an alias after the window would be pushed below it and hide that rows are dealt by ``range``
    sent = sent.select(*rows.columns, F.col("_at.to").alias("range"), F.col("_at.copy").alias("_copy"))
    place = Window.partitionBy("range").orderBy("_copy", *order)
    out = sent.select(*rows.columns, "range", "_copy", F.lead(value_col).over(place).alias("next_value"), F.row_number().over(place).alias("place"))
    return out.where("NOT _copy").drop("_copy")


def once(texts: DataFrame) -> tuple[DataFrame, bool]:
    """``texts (doc_id, text)`` with ``copies``, rows equal in both being one row, so that no range holds many of them; and if there are any such rows.

    A small aggregate of ids and digests tells; if not, no text is moved. Copies meet before they are dealt out."""
    tag = F.md5("text").alias("tag")
    if texts.select("doc_id", tag).groupBy("doc_id", "tag").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return texts.withColumn("copies", F.lit(1).cast("long")), False
    return texts.groupBy("doc_id", tag).agg(F.first("text").alias("text"), F.count("*").alias("copies")).drop("tag"), True


def edited_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, list[int], bool]:
    """``(doc_id, h, n_chars, copies, edited_sha256, f, e, bands)``: fingerprints of the text and the edited text of each distinct row, ``h`` being the text's hash; the bounds
    of the ranges of ids; and if rows are repeated. Then ``self_sha256`` and ``s`` are of the text edited by itself, as the rows before the last of equal ones have it."""
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    base = text_rows(docs, id_col, text_col)
    bounds, weights = id_bounds(base, "doc_id"), rarity(base)
    texts, repeated = once(base)
    by = lambda c: F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col(c), F.lit(1), k))
    rows = with_next(texts, "doc_id", "text", F.xxhash64("text"), bounds)
    keys = [F.xxhash64("text").alias("h"), n.cast("long").alias("n_chars"), "copies", F.sha2(by("next_value"), 256).alias("edited_sha256")]
    values, names = [F.col("text").alias("f"), by("next_value").alias("e")], ["f", "e"]
    if repeated:
        again = F.when(F.col("copies") > 1, by("text"))
        keys, values, names = [*keys, F.sha2(again, 256).alias("self_sha256")], [*values, again.alias("s")], [*names, "s"]
    rows = rows.select("range", "place", "doc_id", *keys, *values)
    kept = [c for c in rows.columns if c not in names]
    return fingerprinted(rows, kept, names, weights).drop("range", "place"), bounds, repeated


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint struct<a, b>)`` for every text."""
    return _all(edited_table(docs, id_col, text_col)[0].select("doc_id", F.col("f").alias("fingerprint"), "copies"))


def _all(rows: DataFrame) -> DataFrame:
    """Rows as often as ``copies`` says."""
    return rows.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("copies")


def edited_report(docs: DataFrame, radius: int = 3, query_step: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: likeness to its edited text and to the next document, and how many documents lie
    within the radius, how many near copies it has (within ``WIDE`` bits, itself among them) and the least id of these
    (for the query set, ids divisible by ``query_step``; null for others).

    Rows of equal ids and texts follow each other in the order of documents; of equal ids with several texts that of
    the larger hash comes first. Null ids are last and no queries."""
    table, bounds, repeated = edited_table(docs, id_col, text_col)
    selves = ["s", "self_sha256"] if repeated else []
    own = checkpointed(table.select("doc_id", "n_chars", "copies", "edited_sha256", F.struct("h", "f").alias("hf"), "e", "bands", *selves))
    out = with_next(own, "doc_id", "hf", F.col("hf.h"), bounds)
    if repeated:  # of equal rows the last is followed by another text, the others by their own
        last = F.struct("edited_sha256", "e", F.col("next_value").alias("x"))
        more = F.struct(F.col("self_sha256").alias("edited_sha256"), F.col("s").alias("e"), F.col("hf").alias("x"))
        ways = F.explode(F.concat(F.array(last), F.array_repeat(more, (F.col("copies") - 1).cast("int")))).alias("way")
        out = out.select("doc_id", "n_chars", "hf", "bands", ways).select("doc_id", "n_chars", "hf", "bands", "way.edited_sha256", "way.e", F.col("way.x").alias("next_value"))
    f, e, x = F.col("hf.f"), F.col("e"), F.col("next_value.f")
    asked = F.col("doc_id") % query_step == 0
    prints = own.select("doc_id", F.col("hf.f").alias("fingerprint"), "bands", "copies")
    prints = _all(prints) if repeated else prints.drop("copies")
    found = near(prints.select("fingerprint"), prints.where(asked).select("fingerprint"), radius).withColumnRenamed("fingerprint", "qf")
    copies = similar(prints, prints.where(asked))
    base = out.select("doc_id", "n_chars", "edited_sha256", to_hex(f).alias("fingerprint"), to_hex(e).alias("edited_fingerprint"), likeness(f, e).alias("near_edited"), likeness(f, x).alias("near_next"), F.when(asked, f).alias("q"), F.when(asked, F.col("bands")).alias("qb"))
    out = base.join(found, F.col("q") == F.col("qf"), "left")
    return out.join(copies, (F.col("q") == F.col("x_fingerprint")) & (F.col("qb") == F.col("x_bands")), "left").drop("q", "qf", "qb", "x_fingerprint", "x_bands")

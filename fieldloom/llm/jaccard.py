"""Exact Jaccard self-join of word-shingle sets with adaptive multi-match prefixes.

Two sets link when ``den * |A & B| >= num * |A | B|``. Equal sets are one class; the join runs over classes.

* Shingles are ordered from rare to common by a count sketch over all documents (fixed size), ties by hash.
  The order only steers the cost; any global order is exact.
* A set of n shingles whose partner must share ``need`` of them has a prefix of ``n - need + l``: linked sets
  share at least ``min(l, l')`` prefix shingles. Each set takes the ``l`` of least estimated cost (length of
  the posting lists read, plus candidates to verify: each must turn up in ``l`` of these lists), up to
  ``MOST_MATCHES``.
* Round 1 verifies, for each prefix shingle, neighbours of its posting list and the pair with its pivot (the
  set in which the shingle comes first); this is linear in the postings and joins large groups of near copies.
  Lists that the sketch expects to be long are dealt over several tasks by the set's id, and the pivots of the
  parts are linked in the same way afterwards.
* Round 2 verifies every other pair that shares enough prefix shingles, passes the size and position filters,
  and is not yet in one component. Lists whose sets are all in one component by now, nearly all of them, are left
  out. In the others, rows of the pivot's component never meet each other, so a group of copies costs no pairs, and
  sets meet only those of the size classes in reach (two at most) whose folded bitmaps allow a link. After it no link
  between components can be left out.
* Pairs are verified first by parity bitmaps, a lower bound of the difference, with a cell at least for each shingle
  of the set, so that they tell long texts apart as well; then on whole texts. Shingles
  are compared by 64-bit hashes throughout; two distinct shingles of a pair of texts with one hash (a chance of
  about 1e-14 for texts of 400 words) would count as shared.

Rows that share an id are looked up by their set. Null, empty and blank texts have no shingles and link with
nothing. Very frequent shingles sort last and are rarely in prefixes.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import checkpointed, fresh, map_texts, small_batches, slices, stored, text_rows
from .components import components
from .wordhash import shingle_sets

SKETCH_BITS, SLICES = 20, 128
BITMAP = 1024
SIGNATURE = 4
MOST_MATCHES = 4
#: Reading one candidate costs about so many posting entries.
VERIFY_COST = 4.0
#: A list is dealt over parts of about so many postings.
PART = 20_000
#: Ids of texts to verify are sent to all executors up to so many (8 bytes each, about 20 MB in a hash table); beyond, they are joined by a shuffle.
MOST_SENT = 400_000
#: Texts are hashed in slices of so many characters.
SLICE = 200_000


def digest(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(s.tobytes())
    return (d >> 64) - (1 << 63), (d & ((1 << 64) - 1)) - (1 << 63)


def _described(rows: DataFrame, k: int) -> DataFrame:
    """Size and digest of each set, and (with a null id) each task's slices of the count sketch."""
    names = ["doc_id", "n", "k1", "k2", "slice", "counts"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts, SLICE):
                sets = shingle_sets(texts[a:b], k)
                np.add.at(sketch, (np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
                n, k1, k2 = zip(*((len(s), *digest(s)) for s in sets))
                none = [None] * (b - a)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids[a:b], n, k1, k2, none, none), kinds)], names=names)
        if sketch.any():
            parts = [zlib.compress(p.tobytes(), 1) for p in sketch.reshape(SLICES, -1)]
            none = [None] * SLICES
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((none, none, none, none, range(SLICES), parts), kinds)], names=names)

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "doc_id long, n long, k1 long, k2 long, slice int, counts binary")


def _summed(parts: DataFrame) -> np.ndarray:
    """The sketch of all tasks; each slice is added up as a stream, the sum has a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
                total[k] = total[k] + own if k in total else own
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["slice", "counts"])

    out = np.zeros((SLICES, (1 << SKETCH_BITS) // SLICES), np.uint64)
    for r in parts.repartition("slice").mapInArrow(run, "slice int, counts binary").collect():
        out[r.slice] = np.frombuffer(r.counts, np.uint64)
    return np.minimum(out.ravel(), np.uint64(0xFFFFFFFF)).astype(np.uint32)


def need_of(n: int, num: int, den: int) -> int:
    """Least number of shared shingles of a set of n with any linked set."""
    return -(-num * n // den)


def prefix(s: np.ndarray, counts: np.ndarray, usual: float, num: int, den: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Chosen number of matches, prefix of a set with rare shingles first, and into how many parts each list is dealt.

    ``usual`` is the load of a counter that holds no frequent shingle; what is beyond is the expected length of a list.
    """
    n = len(s)
    c = counts[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    need = need_of(n, num, den)
    most = min(MOST_MATCHES, need)
    order = np.argsort(c, kind="stable")[: n - need + most]  # s is sorted, so ties are by hash
    extra = np.maximum(c[order] - usual, 0.0)
    read = np.cumsum(extra)[n - need :]
    l = np.arange(1, most + 1)
    best = int(np.argmin(read + VERIFY_COST * read / l + 0.5 * l)) + 1
    size = n - need + best
    return best, s[order[:size]], 1 + (extra[:size] / PART).astype(np.int64)


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the shingles in each of ``BITMAP`` cells or of the next power of two from the size of the set on;
    cells that differ bound the difference from below."""
    size = max(BITMAP, 1 << max(len(s) - 1, 0).bit_length())
    cells = np.bincount((s & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(cells.astype(np.uint8)).tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Cells in which two bitmaps differ, the larger one folded to the size of the other."""
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(np.frombuffer(b, np.uint8).reshape(-1, size), axis=0) for b in (x, y))
    return int(np.bitwise_count(x ^ y).sum(dtype=np.int64))


def signature(bits: bytes) -> np.ndarray:
    """The bitmap folded to ``SIGNATURE`` longs; parities of fewer cells bound the difference just as well, less closely."""
    return np.bitwise_xor.reduce(np.frombuffer(bits, np.int64).reshape(-1, SIGNATURE), axis=0)


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The links among ``pairs(a, b)`` of class ids."""
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("na"), F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("bits").alias("bits_a"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("k1").alias("b1"), F.col("k2").alias("b2"), F.col("bits").alias("bits_b"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            differ = np.array([apart(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist())], np.int64)
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            # shared = (na + nb - difference) / 2, all = (na + nb + difference) / 2
            keep = den * (na + nb - differ) >= num * (na + nb + differ)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "a1", "a2", "b", "b1", "b2")], names=["a", "a1", "a2", "b", "b1", "b2"])

    small_batches(rows.sparkSession)
    close = checkpointed(pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "a1", "a2", "b", "b1", "b2", "na", "nb", "bits_a", "bits_b").mapInArrow(near, "a long, a1 long, a2 long, b long, b1 long, b2 long"))
    wanted = checkpointed(close.select(F.col("a").alias("doc_id")).union(close.select(F.col("b").alias("doc_id"))).distinct())
    texts = rows.join(F.broadcast(wanted) if wanted.count() <= MOST_SENT else wanted, "doc_id", "left_semi")
    both = (
        close.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
        .join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .select("a", "a1", "a2", "text_a", "b", "b1", "b2", "text_b")
    )

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found_a, found_b = [], []
            last: dict[int, tuple] = {}
            for a, a1, a2, ta, b, b1, b2, tb in zip(*(c.to_pylist() for c in batch.columns)):
                sets = []
                for key, want, text in ((a, (a1, a2), ta), (b, (b1, b2), tb)):
                    if key not in last or last[key][0] != want:
                        if len(last) > 64:
                            last.clear()
                        s = shingle_sets([text], k)[0]
                        if digest(s) != want:  # another row of this id
                            break
                        last[key] = (want, s)
                    sets.append(last[key][1])
                if len(sets) == 2:
                    shared = len(np.intersect1d(*sets, assume_unique=True))
                    if den * shared >= num * (len(sets[0]) + len(sets[1]) - shared):
                        found_a.append(a)
                        found_b.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])

    return both.mapInArrow(links, "a long, b long").distinct()


def _classes(docs: DataFrame, k: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``sets(doc_id, n, k1, k2)`` of all rows, and ``(k1, k2, rep, component)`` of the classes that have an id."""
    rows = text_rows(docs, id_col, text_col)
    described = checkpointed(_described(rows, k))
    sets = described.where(F.col("slice").isNull()).select("doc_id", "n", "k1", "k2")
    reps = checkpointed(sets.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")).where("rep IS NOT NULL"))
    counts = _summed(described.where(F.col("slice").isNotNull()).select("slice", "counts"))
    sent = docs.sparkSession.sparkContext.broadcast((counts, float(np.median(counts))))

    def kernel():
        own, usual = sent.value

        def apply(ids, texts):
            out = {c: [] for c in ("k1", "k2", "matches", "tokens", "parts", "bits", "signature")}
            for s in shingle_sets(texts, k):
                l, p, parts = prefix(s, own, usual, num, den) if len(s) else (0, s, s)
                bits = bitmap(s)
                for c, v in zip(out, (*digest(s), l, p.view(np.int64), None if not len(parts) or parts.max() == 1 else parts, bits, signature(bits))):
                    out[c].append(v)
            return out | {"doc_id": ids}

        return apply

    prefixes = map_texts(rows, kernel, "doc_id long, k1 long, k2 long, matches int, tokens array<long>, parts array<int>, bits binary, signature array<long>", SLICE)
    own = reps.select(F.col("rep").alias("doc_id"), "k1", "k2", "n")
    classes = checkpointed(prefixes.join(own, ["doc_id", "k1", "k2"]).withColumnRenamed("doc_id", "rep"))

    postings = classes.select("rep", "n", "matches", "parts", F.posexplode("tokens").alias("pos", "token"))
    n_parts = F.coalesce(F.get("parts", F.col("pos")), F.lit(1))
    postings = postings.select("token", "rep", "n", "matches", "pos", (n_parts > 1).alias("dealt"), F.when(n_parts > 1, F.pmod(F.xxhash64("rep"), n_parts)).otherwise(0).cast("int").alias("part"))
    order = ["pos", "n", "rep"]
    place = Window.partitionBy("token", "part").orderBy(*order)
    lists = checkpointed(
        postings.withColumn("before", F.lag(F.struct("rep", "n")).over(place))
        .withColumn("after", F.lead("rep").over(place))
        .withColumn("pivot", F.first(F.struct("rep", "n")).over(place))
        .where("before IS NOT NULL OR after IS NOT NULL OR dealt").drop("after", "part")
    )

    # round 1: neighbours and pivots, in the parts and then of the parts
    heads = Window.partitionBy("token").orderBy(*order)
    tops = lists.where("dealt AND before IS NULL").withColumn("before", F.lag(F.struct("rep", "n")).over(heads)).withColumn("pivot", F.first(F.struct("rep", "n")).over(heads))
    pair = lambda of, other: of.where(f"{other}.rep <> rep AND {den} * least({other}.n, n) >= {num} * greatest({other}.n, n)").select(F.least(f"{other}.rep", "rep").alias("a"), F.greatest(f"{other}.rep", "rep").alias("b"), "matches")
    first = pair(lists, "before").union(pair(lists, "pivot")).union(pair(tops, "before")).union(pair(tops, "pivot"))
    first = first.groupBy("a", "b").agg(F.count("*").alias("c"), F.min("matches").alias("l")).where("c >= l")
    edges = checkpointed(_verified(first, classes, rows, k, num, den))
    joined = components(edges)

    # round 2: all that share enough, across components, in lists that have several
    at = lists.select("token", "rep", "n", "matches", "pos").join(joined.select(F.col("node").alias("rep"), "component"), "rep", "left")
    at = stored(at.withColumn("component", F.coalesce("component", "rep")), "jaccard-components")
    mixed = at.groupBy("token").agg(F.min("component").alias("least"), F.max("component").alias("largest"), F.min(F.struct(*order, "component")).alias("head"))
    mixed = mixed.where("least <> largest").select("token", F.col("head.component").alias("main"))
    own_bits = classes.select("rep", *[F.col("signature")[i].alias(f"s{i}") for i in range(SIGNATURE)])
    at = at.join(mixed, "token").withColumn("of_main", F.expr("component = main")).drop("main")
    at = stored(at.join(own_bits, "rep"), "jaccard-lists")
    #: sizes of linked sets are at most ``reach`` apart in logarithms; a class is twice as wide, so that two are in reach
    reach = math.log(den / num) * 1.000001 if den > num else 1e-12
    of_size = lambda by: F.floor((F.log("n") + F.lit(by * reach)) / F.lit(2 * reach)).cast("long")
    x = at.where("NOT of_main").withColumn("class", F.explode(F.sequence(of_size(-1), of_size(1)))).alias("x")
    y = at.withColumn("class", of_size(0)).alias("y")
    need = f"({den} + {num}) * (least(x.n - x.pos, y.n - y.pos) + least(x.matches, y.matches) - 1) >= {num} * (x.n + y.n)"
    # parities that differ bound the difference from below, so most pairs that can't link are left out here
    differ = "(" + " + ".join(f"bit_count(x.s{i} ^ y.s{i})" for i in range(SIGNATURE)) + ")"
    may = f"{den} * (x.n + y.n - {differ}) >= {num} * (x.n + y.n + {differ})"
    rest = (
        x.join(y, F.expr(
            "x.token = y.token AND x.class = y.class AND x.component <> y.component AND (y.of_main OR x.rep < y.rep) "
            f"AND {den} * least(x.n, y.n) >= {num} * greatest(x.n, y.n) AND {need} AND {may}"))
        .groupBy(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"))
        .agg(F.count("*").alias("c"), F.min(F.least("x.matches", "y.matches")).alias("l")).where("c >= l")
    )
    more = checkpointed(_verified(rest, classes, rows, k, num, den))
    final = components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    return sets, reps.join(final.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", "rep", F.coalesce("component", "rep").alias("component"))


def linked(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, component_id)``: one row per row of ``docs``.

    ``component_id`` is the least id that links reach, the row's own included; a null id keeps a null
    component unless its set has another id.
    """
    sets, classes = _classes(docs, k, num, den, id_col, text_col)
    of_set = classes.select("k1", "k2", F.col("component").alias("of_set"))
    return sets.join(of_set, ["k1", "k2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("of_set", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns as they are, with one row of each component: that of the least id.

    Rows are judged by their own text, so of two rows that share an id and not their text one can stay and the
    other go; of rows that share id and set one stays. Rows without words stay, all of them. Rows without an id go if
    their set has one elsewhere, and stay otherwise.
    """
    sets, classes = _classes(docs, k, num, den, id_col, text_col)
    at = docs.columns.index(text_col)
    n, k1, k2, key, place, hit = (fresh(docs.columns, c) for c in ("n_shingles", "key_1", "key_2", "key_id", "place", "hit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            found = [(len(s), *digest(s)) for a, b in slices(texts, SLICE) for s in shingle_sets(texts[a:b], k)]
            more = [pa.array(c, pa.int64()) for c in (zip(*found) if found else ((), (), ()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, n, k1, k2])

    small_batches(docs.sparkSession)
    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in (n, k1, k2))])
    as_text = lambda c: F.coalesce(c.cast("long").cast("string"), F.lit("")).alias(key)
    own = docs.mapInArrow(run, schema).withColumn(key, as_text(F.col(id_col)))
    orphans = sets.where("doc_id IS NULL AND n > 0").select("k1", "k2").distinct().join(classes, ["k1", "k2"], "left_anti").select(F.lit("").alias(key), "k1", "k2")
    heads = classes.where("rep = component").select(as_text(F.col("rep")), "k1", "k2").union(orphans)
    heads = heads.select(key, F.col("k1").alias(k1), F.col("k2").alias(k2), F.lit(1).alias(hit))
    met = own.join(heads, [key, k1, k2], "left").where(F.col(hit).isNotNull() | (F.col(n) == 0))
    # equal rows of one id and set: one stays
    met = met.withColumn(place, F.row_number().over(Window.partitionBy(key, k1, k2).orderBy(key)))
    return met.where((F.col(place) == 1) | (F.col(n) == 0) | (F.col(key) == "")).select(docs.columns)

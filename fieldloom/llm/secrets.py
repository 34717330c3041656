"""Secret scans in plain DataFrame functions.

Base spans come from three patterns: assignments of a value of 8 or more characters to a telling name, access
key ids, and hex runs of 32 or more. Further spans come from two character Markov models (first order, one of
random strings, one of ordinary identifiers), trained from labelled samples: a token of 16 or more characters
with letters and digits is a secret when its log-likelihood ratio per transition exceeds the threshold. Added
spans never overlap base ones, and base ones always stay.

Positions are code points, ends exclusive. Null and empty texts have no spans. Texts of any length and number of spans
are done in about the number times its root steps.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_rows

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Runs are matched whole, so those of 32 and more are the same as the long ones of all runs.
HEX = r"[0-9a-f]{32,}"
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
KINDS = ("assign", "access", "hex", "markov")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
STATES = len(ALPHABET) + 1  # 0: any other character, and the start
THRESHOLD = 0.25
SAMPLE_DOCS, SAMPLE_RANDOM = 200, 4_000
_SPANS = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def _states(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def default_samples(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Labelled samples ``(token, random)``.

    Ordinary: words, and neighbours joined as in names, of the ``SAMPLE_DOCS`` documents of least id hash (a
    documented bound). Random: ``SAMPLE_RANDOM`` digests in hex, base 64 and capitals, made from a counter.
    """
    spark = docs.sparkSession
    word = r"[A-Za-z]{3,}"
    rows = text_rows(docs, id_col, text_col)
    # ids first, texts after: no task sees more texts than it keeps; one text (the least) of each id
    ids = rows.select(F.col("doc_id").alias("own_id")).distinct().orderBy(F.xxhash64("own_id"), "own_id").limit(SAMPLE_DOCS)
    rows = rows.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("own_id"))).groupBy("doc_id").agg(F.min("text").alias("text"))
    words = rows.select(F.regexp_extract_all("text", F.lit(word), F.lit(0)).alias("w")).where(F.size("w") > 1)
    pairs = words.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("p"), F.size("w").alias("n"))
    a, b = F.col("p.a"), F.col("p.b")
    ordinary = pairs.select(F.explode(F.array(a, F.concat_ws("_", a, b), F.concat_ws("-", a, b), F.concat(a, F.initcap(b)), F.concat_ws("/", a, b), F.concat(F.upper(a), F.lit("_"), F.upper(b)), F.concat(a, F.lit("_"), F.col("n").cast("string")))).alias("token"), F.lit(0).alias("random"))
    digest = F.sha2(F.col("id").cast("string"), 512)
    packed = F.base64(F.unhex(digest))
    made = spark.range(SAMPLE_RANDOM).select(F.explode(F.array(F.substring(digest, 1, 40), F.substring(F.translate(packed, "\r\n", ""), 1, 40), F.translate(F.substring(packed, 1, 32), "+/=\r\n", ""), F.upper(F.translate(F.substring(packed, 33, 24), "+/=\r\n", "")))).alias("token"), F.lit(1).alias("random"))
    return ordinary.union(made)


def train(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """Log-likelihood ratios of transitions, ``STATES`` x ``STATES`` in row order; null tokens don't count.

    Only the transition counts leave the executors: a table of fixed size.
    """
    steps = samples.where("token IS NOT NULL AND token <> ''").select("random", _states(F.col("token")).alias("s"))
    steps = steps.select("random", F.explode(F.zip_with(F.concat(F.array(F.lit(0)), F.expr("slice(s, 1, size(s) - 1)")), F.col("s"), lambda x, y: x * STATES + y)).alias("step"))
    counts = {(r.random, r.step): r.n for r in steps.groupBy("random", "step").agg(F.count("*").alias("n")).collect()}
    out = [0.0] * (STATES * STATES)
    for x in range(STATES):
        log = []
        for kind in (1, 0):
            own = [counts.get((kind, x * STATES + y), 0) + smoothing for y in range(STATES)]
            total = sum(own)
            log.append([math.log(v / total) for v in own])
        for y in range(STATES):
            out[x * STATES + y] = round(log[0][y] - log[1][y], 3)
    return out


def _let(value: Column, f) -> Column:
    """``f`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _running(values: Column, op) -> Column:
    """For each element what ``op`` (a sum or maximum of numbers from 0 on) gives of those before it.

    Goes by blocks of about the root of the size, so n elements take n times its root steps and no array grows by one."""
    fold = lambda a: F.aggregate(a, F.lit(0), lambda x, y: op(x, y).cast("int"))

    def of(v: Column) -> Column:
        block = lambda i, b: F.slice(v, i * b + 1, b)
        inside = lambda off, own: F.transform(own, lambda _, j: op(off, fold(F.slice(own, F.lit(1), j))).cast("int"))
        each = lambda b, at, totals: F.flatten(F.transform(at, lambda i: _let(fold(F.slice(totals, F.lit(1), i)), lambda off: _let(block(i, b), lambda own: inside(off, own)))))
        with_size = lambda b: _let(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / b).cast("int")), lambda at: _let(F.transform(at, lambda i: fold(block(i, b))), lambda totals: each(b, at, totals)))
        return _let(F.ceil(F.sqrt(F.greatest(F.size(v), F.lit(1)))).cast("int"), with_size)

    return _let(values, of)


def _found(text: Column, pattern: str, kind: str, keep) -> Column:
    """Matches of a pattern with their places: gaps between matches give the offsets."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), matches, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))), lambda p: p["m"].isNotNull())

    def span(p: Column, at: Column) -> Column:
        start = (at + p["gap"]).cast("int")
        return F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (start + F.length(p["m"])).cast("int").alias("end"), F.lit(kind).alias("kind"), p["m"].alias("value"))

    placed = _let(pairs, lambda ps: F.zip_with(ps, _running(F.transform(ps, lambda p: (p["gap"] + F.length(p["m"])).cast("int")), lambda x, y: x + y), span))
    return F.filter(placed, lambda s: keep(s["value"])).cast(_SPANS)


def _meets(spans: Column, s: Column) -> Column:
    """Whether the span ``s`` overlaps one of ``spans``, which are apart from each other and sorted: a binary search."""
    start = F.struct(F.lit(0).alias("lo"), F.size(spans).alias("hi"))

    def step(acc, _):
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        right = (acc["lo"] < acc["hi"]) & (F.get(spans, mid)["start"] < s["end"])
        return F.struct(F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"), F.when(right, acc["hi"]).otherwise(mid).alias("hi"))

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + F.lit(1))).cast("int"))
    last = F.get(spans, F.aggregate(steps, start, step)["lo"] - 1)
    return (F.size(spans) > 0) & F.coalesce(last["end"] > s["start"], F.lit(False))


def _guarded(text: Column, guard: Column, spans: Column) -> Column:
    return F.when(guard, spans).otherwise(F.array().cast(_SPANS))


def _ratio(model: Column, token: Column) -> Column:
    """Mean log-likelihood ratio of the transitions of a token."""
    s = _states(token)
    zero = F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("total"))
    run = F.aggregate(s, zero, lambda acc, y: F.struct(y.cast("int").alias("last"), (acc["total"] + F.get(model, acc["last"] * STATES + y)).alias("total")))
    return run["total"] / F.length(token)


def _spans(rows: DataFrame, model: list[float], threshold: float) -> DataFrame:
    """Adds ``base`` and ``spans`` to rows with a ``text`` that isn't null."""
    t = F.col("text")
    table = F.split(F.lit(",".join(f"{x:g}" for x in model)), ",").cast("array<double>")
    kinds = [
        _guarded(t, t.rlike(r"(?i)(?:passw|secret|token|api_?key)"), _found(t, ASSIGN, "assign", lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 8)),
        _guarded(t, t.contains("AKIA"), _found(t, ACCESS, "access", lambda m: F.length(m) >= 16)),
        _guarded(t, t.rlike(HEX), _found(t, HEX, "hex", lambda m: F.length(m) >= 32)),
    ]
    columns = rows.columns
    rows = rows.withColumns({f"base_{i}": c for i, c in enumerate(kinds)})
    base = [F.col(f"base_{i}") for i in range(len(kinds))]
    mixed = lambda m: m.rlike("[0-9]") & m.rlike("[A-Za-z]")
    more = _guarded(t, t.rlike(TOKEN), _found(t, TOKEN, "markov", lambda m: mixed(m) & (_ratio(table, m) > threshold)))
    apart = F.filter(more, lambda s: ~(_meets(base[0], s) | _meets(base[1], s) | _meets(base[2], s)))
    return rows.select(*columns, F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*base, apart)).alias("spans"))


def scan(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, base, spans)``: base spans, and all spans, by start, then kind as listed."""
    return _spans(text_rows(docs, id_col, text_col), model, threshold)


def redact_documents(docs: DataFrame, model: list[float], threshold: float = THRESHOLD, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with every span replaced by ``[kind]``, all other columns as they are; ``size_col``, if there,
    is set anew for texts that changed."""
    rows = _spans(docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), model, threshold)
    rows = rows.select("row", F.size("spans").alias("n"), _redacted(F.col("text"), F.col("spans")).alias("done"))
    own = lambda c: F.col("row").getField(c)
    new = {text_col: F.when(F.col("n") == 0, own(text_col)).otherwise(F.col("done"))}
    if size_col in docs.columns:
        new[size_col] = F.when(F.col("n") == 0, own(size_col)).otherwise(F.length("done").cast(docs.schema[size_col].dataType))
    return rows.select(*[new.get(c, own(c)).alias(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _redacted(t: Column, spans: Column) -> Column:
    """The text with ``[kind]`` for each group of overlapping spans, by the first of them.

    Spans are taken in blocks of about the root of their number, so that places are sought in short pieces of a long text."""

    def of(all_: Column) -> Column:
        # those that begin where all before have ended, with the end before them
        heads = F.filter(F.zip_with(all_, _running(F.transform(all_, lambda s: s["end"]), F.greatest), lambda s, e: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), e.alias("from"))), lambda h: h["start"] >= h["from"])
        last = F.aggregate(all_, F.lit(0), lambda x, s: F.greatest(x, s["end"]))
        piece = lambda part, h, at: F.concat(F.substring(part, h["from"] - at + 1, h["start"] - h["from"]), F.lit("["), h["kind"], F.lit("]"))

        def block(own: Column) -> Column:
            at, end = F.get(own, F.lit(0))["from"], F.element_at(own, -1)["start"]
            return _let(F.struct(F.substring(t, at + 1, end - at).alias("part"), at.alias("at")), lambda p: F.array_join(F.transform(own, lambda h: piece(p["part"], h, p["at"])), ""))

        blocks = lambda hs, b: F.transform(F.sequence(F.lit(0), F.floor((F.size(hs) - 1) / b).cast("int")), lambda i: _let(F.slice(hs, i * b + 1, b), block))
        body = _let(heads, lambda hs: _let(F.ceil(F.sqrt(F.size(hs))).cast("int"), lambda b: F.array_join(blocks(hs, b), "")))
        return F.concat(body, F.substring(t, last + 1, F.length(t)))

    return F.when(F.size(spans) == 0, t).otherwise(_let(spans, of))


def redact(scanned: DataFrame) -> DataFrame:
    """``(doc_id, text)`` with each span replaced by ``[kind]``; of overlapping spans the first to start stands for all."""
    return scanned.select("doc_id", _redacted(F.col("text"), F.col("spans")).alias("text"))


def digests(scanned: DataFrame) -> DataFrame:
    """One row per document: counts of base spans, their digest, and all spans."""
    n = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))

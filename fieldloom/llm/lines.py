"""Dedup of repeated lines and passages.

Two kinds of text go when they occur again anywhere, but for their first occurrence (least id, then place):

* chunks of lines. A line ends at a line feed or after a sentence end followed by a blank, and has a word at least. A
  chunk ends after a line where a rolling hash over the last two line hashes says so, so borders depend on nearby
  lines only and shift with the text; chunks have ``LEAST_LINES`` lines at least and ``MOST_LINES`` at most (the
  method's own limits), and those of ``LEAST_WORDS`` words or more count.
* passages: equal runs of ``PASSAGE_WORDS`` words or more, wherever they begin and end, with or without ends of
  lines or sentences inside. Windows of ``WINDOW`` words are winnowed (a window is an anchor if its hash is the
  least of some ``NEAR`` windows in a row), so two occurrences of a passage always share an anchor. From
  there the removed range is extended, both ways, as far as the texts agree.

Anchors and chunks are met by a 64-bit hash. Each document's matches with one other at one distance make a
stretch; the other document hands over its bytes of the stretch, with ``PASSAGE_WORDS`` words around it, and only
bytes that agree are removed. So texts that merely share a hash never count as repeated. An anchor looks at the first
occurrence of its own words only: if each anchor of a passage occurs earlier in yet other text, what the passage
shares with none of these stays.

Null and empty texts have no words and stay empty. Null ids come first. Rows that share an id are ordered by the md5 of their texts; of
rows equal in both one comes first, and from the others goes all that the method finds in a text that is there twice: all
of it from ``PASSAGE_WORDS`` words on, else its chunks. Where ids are distinct and none is null they are the rows' keys; otherwise
rows get keys by rank (:func:`keyed`), so every value of a long is an id like any other. The bytes that remain are never changed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, small_batches, stored
from .ranges import numbered
from .wordhash import BLANK as _BLANK
from .wordhash import VALUES, mixed, powers

DIVISOR, LEAST_LINES, MOST_LINES, LEAST_WORDS = 2, 2, 24, 10
PASSAGE_WORDS, WINDOW = 50, 16
NEAR = PASSAGE_WORDS - WINDOW + 1
#: Matches of one document with another at one distance are one stretch up to so many bytes apart.
GAP = 300
#: Texts are scanned in slices of so many characters (one text at least; a scan takes about 60 bytes for each of them).
SLICE = 200_000
_WORD = re.compile(rb"[^\t-\r ]+")
_FEED, _DOT, _BANG, _QUERY, _SPACE = b"\n.!? "


class Scan:
    """Words and lines of several texts, and the hashes of any stretch of words."""

    def __init__(self, raws: list[bytes]) -> None:
        data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
        blank = _BLANK[data]
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        up, self.down = powers(len(data) + 1)
        self.total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(up[: len(data)] * VALUES[data], out=self.total[1:])
        self.begins = np.cumsum([1, *(len(r) + 1 for r in raws)])[:-1]
        self.which = np.searchsorted(self.begins, self.start, "right") - 1
        # the last byte of each line: a line feed, or the blank after a sentence end
        stop = (data[:-1] == _DOT) | (data[:-1] == _BANG) | (data[:-1] == _QUERY)
        ends = data == _FEED
        ends[1:] |= stop & (data[1:] == _SPACE)
        line = np.searchsorted(np.flatnonzero(ends), self.start)
        #: first word of each line that has words, and the number of words last
        self.first = np.concatenate([np.flatnonzero(np.diff(line, prepend=-1)), [len(line)]])

    def hashes(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Hashes of the bytes from the beginning of word i to the end of word j - 1."""
        return mixed((self.total[self.end[j - 1]] - self.total[self.start[i]]) * self.down[self.start[i]])

    def chunks(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and the word after the last of the chunks that count."""
        first = self.first
        if len(first) <= LEAST_LINES:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        h = self.hashes(first[:-1], first[1:])
        text = self.which[first[:-1]]
        new = np.concatenate([[True], text[1:] != text[:-1]])
        before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
        before[new] = 0
        border = (mixed(before * np.uint64(0x9E3779B97F4A7C15) + h) % np.uint64(DIVISOR) == 0).tolist()
        out, at = [], 0
        for k, fresh_text in enumerate([*new.tolist()[1:], True], 1):
            if k - at >= LEAST_LINES and (border[k - 1] or k - at >= MOST_LINES or fresh_text):
                out.append((at, k))
                at = k
            if fresh_text:
                at = k
        i, j = (first[np.array(x, np.int64)] for x in (zip(*out) if out else ((), ())))
        long = j - i >= LEAST_WORDS
        return i[long], j[long]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and the word after the last of the winnowed windows."""
        n, which = len(self.start) - WINDOW + 1, self.which
        if n < NEAR:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.arange(n)
        g = self.hashes(at, at + WINDOW)
        low, size = g, 1  # least of NEAR in a row
        while size < NEAR:
            step = min(size, NEAR - size)
            low, size = np.minimum(low[:-step], low[step:]), size + step
        none = np.zeros(NEAR - 1, np.uint64)
        high = np.concatenate([none, np.where(which[: len(low)] == which[PASSAGE_WORDS - 1 :], low, np.uint64(0)), none])
        size = 1
        while size < NEAR:
            step = min(size, NEAR - size)
            high, size = np.maximum(high[:-step], high[step:]), size + step
        # windows that reach into the next text are in no row of one text
        i = np.flatnonzero(high == g)
        i = i[which[i] == which[i + WINDOW - 1]]
        return i, i + WINDOW

    def places(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first byte and the byte after the last of stretches of words."""
        w = self.which[i]
        return w, self.start[i] - self.begins[w], self.end[j - 1] - self.begins[w]


def _match_rows(rows: DataFrame) -> DataFrame:
    """``(k, id, b, e, chunk, again)``: hash and place of each chunk and each anchor, and whether its text has it earlier."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_()]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = batch.column(0).to_numpy()
            for a, z in slices(texts, SLICE):
                scan = Scan([t.encode() for t in texts[a:z]])
                for chunk, (i, j) in ((True, scan.chunks()), (False, scan.anchors())):
                    which, b, e = scan.places(i, j)
                    k, again = scan.hashes(i, j), np.ones(len(i), bool)
                    again[np.unique(k ^ mixed(which.astype(np.uint64) + np.uint64(1)), return_index=True)[1]] = False
                    columns = k.view(np.int64), ids[a:z][which], b, e, np.full(len(i), chunk), again
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["k", "id", "b", "e", "chunk", "again"])

    small_batches(rows.sparkSession)
    return rows.mapInArrow(run, "k long, id long, b int, e int, chunk boolean, again boolean")


def stretches(id_: int, matches: list[tuple]) -> list[tuple]:
    """``(src, sb, se, b, around, chunks)`` from matches ``(b, e, chunk, src, sb)``: those with one document at one
    distance joined. ``around`` tells if there are anchors; ``chunks`` are the places of chunks. What occurs several
    times in the document ``id_`` is held against the time before there, so a text that runs into itself has one
    stretch, not one for each time."""
    out, nearest, last_at = [], [], {}
    for b, e, chunk, src, sb in sorted(matches):
        src, sb, key = *last_at.get((src, sb, chunk), (src, sb)), (src, sb, chunk)
        last_at[key] = id_, b
        nearest.append((b, e, chunk, src, sb))
    for b, e, chunk, src, sb in sorted(nearest, key=lambda m: (m[3], m[0] - m[4], m[0])):
        if out and out[-1][0] == src and out[-1][2] - out[-1][1] == b - sb and b <= out[-1][4] + GAP:
            last = out[-1]
            last[4], last[5] = max(last[4], e), last[5] or not chunk
        else:
            last = [src, sb, b, None, e, not chunk, []]
            out.append(last)
        if chunk:
            last[6].append((b, e))
    return [(src, sb, sb + e - b, b, around, chunks) for src, sb, b, _, e, around, chunks in out]


def handed(raw: bytes, sb: int, se: int, around: bool) -> tuple[int, bytes]:
    """Place and bytes of a stretch, with ``PASSAGE_WORDS`` words on both sides if ``around``."""
    if not around:
        return sb, raw[sb:se]
    left = right = 8 * PASSAGE_WORDS
    while left < sb and len(raw[sb - left : sb].split()) <= PASSAGE_WORDS:
        left *= 2
    while se + right < len(raw) and len(raw[se : se + right].split()) <= PASSAGE_WORDS:
        right *= 2
    at = max(0, sb - left)
    return at, raw[at : se + right]


def ranges(raw: bytes, found: list[tuple]) -> list[tuple[int, int]]:
    """Byte ranges to remove, sorted and apart, for stretches ``(b, sb, own, chunks, at, body)``: the places in
    this text and in the other, if the other is this document, chunks, and what the other handed over."""
    blank = _BLANK[np.frombuffer(b"\n" + raw + b"\n", np.uint8)]
    edge = np.flatnonzero(blank[1:] != blank[:-1]).tolist()
    starts, ends = edge[::2], edge[1::2]
    out = []
    for b, sb, own, chunks, at, body in found:
        shift = b - sb
        begin, end = max(0, at + shift), min(len(raw), at + shift + len(body))
        mine, other = np.frombuffer(raw[begin:end], np.uint8), np.frombuffer(body, np.uint8)[begin - at - shift :][: end - begin]
        if len(mine) != len(other):
            continue
        wrong = np.flatnonzero(mine != other) + begin
        for x, y in zip(chunks[::2], chunks[1::2]):
            i = bisect_left(wrong, x)
            if begin <= x and y <= end and (i == len(wrong) or wrong[i] >= y) and not (own and shift < y - x):
                out.append((x, y))
        for x, y in zip([begin, *(wrong + 1).tolist()], [*wrong.tolist(), end]):
            if y - x < 2 * PASSAGE_WORDS - 1:
                continue
            # whole words in both texts: a border inside a word of either text is moved inwards
            i, j = bisect_left(starts, x), bisect_left(ends, y + 1)
            while i < j and not _bordered(body, starts[i] - shift - at, -1):
                i += 1
            while i < j and not _bordered(body, ends[j - 1] - shift - at, 1):
                j -= 1
            if j - i < PASSAGE_WORDS:
                continue
            x, y = starts[i], ends[j - 1]
            if own and shift < y - x:  # it runs into itself: its first words stay whole
                x = next((s for s in starts[i:j] if s >= ends[i + PASSAGE_WORDS - 1] - shift), y)
            if x < y:
                out.append((x, y))
    joined: list[list[int]] = []
    for x, y in sorted(out):
        if joined and x <= joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], y)
        else:
            joined.append([x, y])
    return [(x, y) for x, y in joined]


def _bordered(body: bytes, i: int, side: int) -> bool:
    """Whether a word of ``body`` can begin (side -1) or end (side 1) at ``i``; at the edge of what was handed over too."""
    k = i - 1 if side < 0 else i
    return k < 0 or k >= len(body) or bool(_BLANK[body[k]])


def copied(raw: bytes) -> list[tuple[int, int]]:
    """What goes from a text that is there whole before: all of it, or, if it is no passage, its chunks."""
    words = list(_WORD.finditer(raw))
    return [(words[0].start(), words[-1].end())] if len(words) >= PASSAGE_WORDS else chunk_places(raw)


def without(text: str, found: list[tuple], again: bool = False) -> tuple[str, int]:
    """What remains of a text, and how many ranges went. Blanks after a removed range go with it. ``again``: an equal row comes before."""
    if not found and not again:
        return text, 0
    raw = text.encode()
    gone = copied(raw) if again else ranges(raw, found)
    if not gone:
        return text, 0
    kept, at = [], 0
    for x, y in gone:
        while y < len(raw) and _BLANK[raw[y]]:
            y += 1
        kept.append(raw[at : max(at, x)])
        at = y
    kept.append(raw[at:])
    out = b"".join(kept)
    if not out.strip():
        out = b""
    return out.decode(), len(gone)


def parts(batches, rows: int = 500):
    """Batches in pieces of so many rows, so that few are Python objects at a time."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def _listed(column: pa.ListArray) -> list[list[tuple]]:
    """Lists of structs as lists of tuples; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    items = list(zip(*(f.to_pylist() for f in column.flatten().flatten())))
    at = [0, *accumulate(n or 0 for n in column.value_lengths().to_pylist())]
    return [items[a:b] for a, b in zip(at, at[1:])]


def keyed(docs: DataFrame, id_col: str, text_col: str, key: str, again: str) -> tuple[DataFrame, bool]:
    """``docs`` with an order-preserving key of each (id, text), and whether an equal row comes before; and if the ids are the keys.

    One small aggregate of the ids tells if they will do as keys. If not, the distinct (id, md5 of the text) are ranked, and rows that are
    equal in both (those alone are written and dealt out) are numbered.
    """
    id_ = F.col(id_col).cast("long")
    many = docs.select(id_.alias("i")).groupBy("i").agg(F.count("*").alias("n")).where("i IS NULL OR n > 1")
    if many.isEmpty():
        return docs.withColumns({key: F.coalesce(id_, F.lit(0)), again: F.lit(False)}), True  # no id is null here; joins need not ask
    taken = docs.columns
    i, tag, n = (fresh([*taken, key, again], f"{key}_{x}") for x in ("id", "tag", "n"))
    own = docs.withColumns({i: id_, tag: F.md5(F.coalesce(F.col(text_col), F.lit("")))})
    ranks = own.select(F.lit("").alias("all"), F.col(i).alias("i"), F.col(tag).alias("t")).groupBy("all", "i", "t").agg(F.count("*").alias("c"))
    ranks = stored(numbered(ranks, "all", ["i", "t"]).select("i", "t", F.col("idx").alias("r"), "c"), "line-keys")
    i2, tag2 = fresh([*taken, key, again, i, tag, n], f"{i}_"), fresh([*taken, key, again, i, tag, n], f"{tag}_")
    ranks = ranks.select(F.col("i").alias(i2), F.col("t").alias(tag2), F.col("r").alias(key), F.col("c").alias(n))
    own = own.join(ranks, F.col(i).eqNullSafe(F.col(i2)) & (F.col(tag) == F.col(tag2))).select(*taken, key, n)
    single, copies = own.where(F.col(n) == 1).drop(n), own.where(F.col(n) > 1).drop(n)
    place = numbered(copies.select(F.col(key).alias("group_"), F.struct(*taken).alias("row_")), "group_", [])
    copies = stored(place.select("row_.*", F.col("group_").alias(key), (F.col("idx") > 0).alias(again)), "line-copies")
    return single.withColumn(again, F.lit(False)).union(copies.select(*taken, key, again)), False


def repeats(docs: DataFrame, key: str, text_col: str, again: str) -> DataFrame:
    """``(id, found)``: for each key that has any, the stretches of its text with earlier text (see :func:`ranges`); one row of each key counts."""
    rows = docs.where(~F.col(again)).select(F.col(key).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    all_ = stored(_match_rows(rows), "line-matches")
    own_id = F.when(~F.col("again"), F.col("id"))
    first = all_.groupBy("k", "chunk").agg(F.count("*").alias("n"), F.min(own_id).alias("src"), F.min_by(F.when(~F.col("again"), F.col("b")), own_id).alias("sb"))
    # written apart, so that the join deals both sides anew and AQE can split a frequent hash
    first = stored(first.where("n > 1").drop("n"), "line-firsts")
    met = all_.join(first.hint("shuffle_hash"), ["k", "chunk"]).where("id <> src OR b <> sb").select("id", F.struct("b", "e", "chunk", "src", "sb").alias("m"))
    grouped = met.groupBy("id").agg(F.collect_list("m").alias("ms"))
    schema = pa.schema([("id", pa.int64()), ("b", pa.int32()), ("src", pa.int64()), ("sb", pa.int32()), ("se", pa.int32()), ("around", pa.bool_()), ("chunks", pa.list_(pa.int32()))])

    def join(batches):
        for batch in parts(batches):
            out = [[] for _ in schema]
            for id_, ms in zip(batch.column(0).to_pylist(), _listed(batch.column(1))):
                for src, sb, se, b, around, chunks in stretches(id_, ms):
                    for column, v in zip(out, (id_, b, src, sb, se, around, [p for c in chunks for p in c])):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    own = stored(grouped.mapInArrow(join, "id long, b int, src long, sb int, se int, around boolean, chunks array<int>"), "line-stretches")
    asked = own.select("src", "sb", "se", "around").distinct().groupBy("src").agg(F.collect_list(F.struct("sb", "se", "around")).alias("asked"))
    sources = rows.join(asked, rows["id"] == asked["src"]).select("src", "text", "asked")

    def hand(batches):
        names = ["src", "sb", "se", "around", "at", "body"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.binary()]
        for batch in parts(batches):
            out, size = [[] for _ in kinds], 0
            for src, text, asked_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _listed(batch.column(2))):
                raw = text.encode()
                for sb, se, around in asked_:
                    at, body = handed(raw, sb, se, around)
                    for column, v in zip(out, (src, sb, se, around, at, body)):
                        column.append(v)
                    size += len(body)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)
                        out, size = [[] for _ in kinds], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=names)

    given = sources.mapInArrow(hand, "src long, sb int, se int, around boolean, at int, body binary")
    both = own.join(given, ["src", "sb", "se", "around"])
    return both.groupBy("id").agg(F.collect_list(F.struct("b", "sb", (F.col("src") == F.col("id")).alias("own"), "chunks", "at", "body")).alias("found"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text, n_removed)``: every text without its repeated parts, and how many ranges of it went."""
    rows, plain = keyed(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), "doc_id", "text", "key", "again")
    found = repeats(rows, "key", "text", "again").withColumnRenamed("id", "of")
    if plain:  # ids and texts as ``repeats`` deals them out to the documents that hand over: one exchange serves both
        marked = rows.select(F.col("key").alias("id"), "text").join(found, F.col("id") == F.col("of"), "left").select(F.col("id").alias("doc_id"), "text", F.lit(False).alias("again"), "found")
    else:
        marked = rows.join(found, F.col("key") == F.col("of"), "left").select("doc_id", "text", "again", "found")
    kinds = [pa.int64(), pa.string(), pa.int64()]

    def run(batches):
        for batch in parts(batches):
            ids, texts, agains, founds = *(batch.column(i).to_pylist() for i in range(3)), _listed(batch.column(3))
            for a, b in slices(texts):
                out = [[] for _ in kinds]
                for i in range(a, b):
                    for column, v in zip(out, (ids[i], *without(texts[i], founds[i], agains[i]))):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], names=["doc_id", "text", "n_removed"])

    return marked.mapInArrow(run, "doc_id long, text string, n_removed long")


def dedup_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """The documents with repeated parts removed, all other columns as they are; ``size_col``, if there, is set
    anew for texts that changed. Documents of which nothing remains go; texts that were empty before stay."""
    key, again, more = (fresh(docs.columns, f"drop_{x}") for x in ("key", "again", "found"))
    rows, _ = keyed(docs, id_col, text_col, key, again)
    found = repeats(rows, key, text_col, again).select(F.col("id").alias(fresh(docs.columns, "drop_id")), F.col("found").alias(more))
    marked = rows.join(found, F.col(key) == F.col(found.columns[0]), "left").drop(key, found.columns[0])
    at, size_at = docs.columns.index(text_col), docs.columns.index(size_col) if size_col in docs.columns else None

    def run(batches):
        for batch in parts(batches):
            columns, texts, keep = list(batch.columns[:-2]), batch.column(at).to_pylist(), []
            sizes = batch.column(size_at).to_pylist() if size_at is not None else None
            agains, founds = batch.column(len(columns)).to_pylist(), _listed(batch.column(len(columns) + 1))
            for r in range(len(texts)):
                before = texts[r] or ""
                if founds[r] or agains[r]:
                    text, _ = without(before, founds[r], agains[r])
                    if text != before:
                        texts[r] = text
                        if sizes is not None:
                            sizes[r] = len(text)
                keep.append((texts[r] or "") == before or bool(texts[r].strip()))
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                columns[size_at] = pa.array(sizes, batch.schema.field(size_at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-2]).filter(pa.array(keep, pa.bool_()))

    return marked.mapInArrow(run, docs.schema)


def chunk_places(raw: bytes) -> list[tuple[int, int]]:
    """Places of the chunks of one text that count."""
    scan = Scan([raw])
    _, b, e = scan.places(*scan.chunks())
    return list(zip(b.tolist(), e.tolist()))


def brute_force(docs: list[tuple[int | None, str | None]]) -> list[str]:
    """The same on one machine, for tests: what remains of each row. Passages are sought at every word, not at anchors."""
    import hashlib

    order = sorted(range(len(docs)), key=lambda r: (docs[r][0] is not None, docs[r][0] or 0, hashlib.md5((docs[r][1] or "").encode()).hexdigest()))
    chunks: dict[bytes, list] = {}
    windows: dict[bytes, tuple[int, int]] = {}
    out = [""] * len(docs)
    for i in order:
        raw = (docs[i][1] or "").encode()
        gone = bytearray(len(raw))
        for x, y in chunk_places(raw):
            body = raw[x:y]
            if chunks.setdefault(body, (i, x)) != (i, x) and not (chunks[body][0] == i and x - chunks[body][1] < y - x):
                gone[x:y] = b"\x01" * (y - x)
        w = [m.span() for m in _WORD.finditer(raw)]
        for k in range(len(w) - PASSAGE_WORDS + 1):
            x, y = w[k][0], w[k + PASSAGE_WORDS - 1][1]
            doc, f = windows.setdefault(raw[x:y], (i, k))
            if doc == i and f < k < f + PASSAGE_WORDS:  # it runs into itself: its first words stay whole
                d = k - f
                while f and raw[w[f - 1][0] : w[f][0]] == raw[w[f - 1 + d][0] : w[f + d][0]]:
                    f -= 1
                x = w[max(k, f + PASSAGE_WORDS)][0] if max(k, f + PASSAGE_WORDS) < k + PASSAGE_WORDS else y
            if (doc, f) != (i, k):
                gone[x:y] = b"\x01" * (y - x)
        cut = [m.span() for m in re.finditer(rb"\x01+", gone)]
        for x, y in reversed(cut):
            while y < len(raw) and _BLANK[raw[y]]:
                y += 1
            raw = raw[:x] + raw[y:]
        out[i] = raw.decode() if raw.strip() or not cut else ""
    return out

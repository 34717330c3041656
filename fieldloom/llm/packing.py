"""Cost-balanced packing of tokenised documents into sequences.

A piece of L tokens costs ``L + quadratic * L * L`` (dense layers plus attention). Documents are packed in
blocks of bounded size, in the task that read them, so nothing is shuffled and memory doesn't follow the
input. In a block, whole multiples of the sequence length of a long document become sequences of their own;
what is left of each document is dealt in descending order to the sequence of least cost that can still take
it whole, and is cut only where none can. The capacities of a block's sequences are fixed beforehand: as many
full ones as its tokens fill, then powers of two for the rest (binary expansion), which need no padding. As
they add up to the block's tokens, every sequence ends full.

Null and empty texts give one piece, the end id. Ties go to the sequence made first. Repeated rows are packed
each on its own.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import slices, text_rows

TABLE_WORDS = 240_000
#: What the word table relies on: words end at white space, letters are lower-cased, marks stand apart from letters.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True}
#: Parts of a lower-case ASCII word without apostrophes that the tokenizer tells apart.
_PARTS = re.compile("[a-z]+|[0-9]|[^a-z0-9]+")
BLOCK_TOKENS = 400_000
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """Byte -> letter of the byte-level alphabet: printable bytes stand for themselves, others follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _latin1(text: str) -> bool:
    """Whether all letters are Latin-1: those have no case rules of their own and are composed already."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class _Table(dict):
    """Word (UTF-8) -> little-endian uint32 ids; a word that lacks is encoded when it is asked for.

    There are two generations of at most half the limit each, so words that come again and again stay.
    """

    def __init__(self, tokenizer, limit: int) -> None:
        self.tokenizer, self.letters, self.limit, self.old = tokenizer, _byte_letters(), limit, {}

    def turn(self) -> None:
        if len(self) > self.limit // 2:
            self.old = dict(self)
            self.clear()

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encoded(word)
        self[word] = ids
        return ids

    def _encoded(self, word: bytes) -> bytes:
        w = word.decode()
        parts = _PARTS.findall(w) if w.isascii() and "'" not in w and "<|" not in w else [w]
        if len(parts) > 1 and w == w.lower():
            return b"".join([self[p.encode()] for p in parts])
        if w[-1] in ".," and w[:-1].isalpha() and _latin1(w) and w == w.lower():
            return self[word[:-1]] + self[word[-1:]]
        if w.isalpha() and _latin1(w) and w == w.lower():
            own = w if w.isascii() else "".join([self.letters[b] for b in word])
            return np.array([t.id for t in self.tokenizer.model.tokenize(own)], "<u4").tobytes()
        return np.array(self.tokenizer.encode(w, add_special_tokens=False).ids, "<u4").tobytes()


class WordIds:
    """Little-endian uint32 ids of a text, from a table of its words.

    The tokenizer drops white space and none of its pieces holds any, so the words between ASCII blanks are
    encoded apart; each distinct one is encoded by the library once per worker. Texts of Latin-1 letters are
    lower-cased first, as the tokenizer does itself. A full stop or comma after a word of letters is a word of its
    own to the tokenizer. Words of lower-case Latin-1 letters go to the library's model directly, others through
    its whole chain. The tokenizer's own description is checked for these rules at load; another tokenizer gets
    whole texts.
    """

    def __init__(self, tokenizer_path: str, limit: int = TABLE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        told = json.loads(self.tokenizer.to_str())
        steps = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
        bytewise = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
        plain = all(not t["normalized"] and not t["lstrip"] and not t["rstrip"] for t in told["added_tokens"])
        self.by_words = told["normalizer"] == NORMALIZER and steps[0] == SPLIT and bytewise and plain and told["model"]["type"] == "BPE" and not told["model"].get("dropout")
        self.table = _Table(self.tokenizer, limit)

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_words:
            return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.table.turn()
        get, out = self.table.__getitem__, []
        for t in texts:
            if _latin1(t) and "<|" not in t:  # names of special tokens stay as they are
                t = t.lower()
            out.append(b"".join(map(get, t.encode().split())))
        return out


_LOADED: dict[str, WordIds] = {}


def word_ids(tokenizer_path: str) -> WordIds:
    """The table of this worker; it lives as long as the worker does."""
    if tokenizer_path not in _LOADED:
        _LOADED.clear()
        _LOADED[tokenizer_path] = WordIds(tokenizer_path)
    return _LOADED[tokenizer_path]


def capacities(total: int, size: int) -> list[int]:
    """Sequence capacities that add up to ``total``: full ones, then the powers of two of the rest."""
    rest = total % size
    return [size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack_block(lengths: list[int], size: int, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of one block of documents."""
    pieces, sequence, rests = [], 0, []
    for d, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            pieces.append((d, start, size, sequence, 0))
            sequence += 1
        if n % size:
            rests.append((-(n % size), d, n - n % size))
    room = np.array(capacities(-sum(r[0] for r in rests), size), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))
    heapq.heapify(rests)
    while rests:
        n, d, start = heapq.heappop(rests)
        n = -n
        fits = room >= n
        if fits.any():
            take, at = n, int(np.where(fits, cost, np.inf).argmin())
        else:  # cut: the least costly of those that have room
            at = int(np.where(room > 0, cost, np.inf).argmin())
            take = int(room[at])
            heapq.heappush(rests, (take - n, d, start + take))
        pieces.append((d, start, take, sequence + at, int(used[at])))
        room[at] -= take
        used[at] += take
        cost[at] += take + quadratic * take * take
    return pieces


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, quadratic: float = 1 / 2048, block_tokens: int = BLOCK_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece; sequence ids are unique over all tasks (task number, then a counter)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words, base = word_ids(tokenizer_path), TaskContext.get().partitionId() << 40
        end, waiting, tokens = np.array([end_id], "<u4").tobytes(), [], 0

        def flush():
            nonlocal base, waiting, tokens
            rows = pack_block([len(b) // 4 for _, b in waiting], size, quadratic)
            out = [[] for _ in range(7)]
            for d, start, n, seq, offset in rows:
                doc_id, b = waiting[d]
                for column, v in zip(out, (doc_id, start, n, zlib.crc32(b[4 * start : 4 * (start + n)]), len(b) // 4, base + seq, offset)):
                    column.append(v)
            base += max((r[3] for r in rows), default=-1) + 1
            waiting, tokens = [], 0
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                for doc_id, own in zip(ids[a:b], words.encode(texts[a:b])):
                    waiting.append((doc_id, own + end))
                    tokens += len(own) // 4 + 1
                    if tokens >= block_tokens:
                        yield flush()
        if waiting:
            yield flush()

    return text_rows(docs, id_col, text_col).mapInArrow(run, SCHEMA)

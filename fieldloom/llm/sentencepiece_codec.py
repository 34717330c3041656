"""SentencePiece encoding and decoding with a distinct-chunk table.

The vocabulary has no piece in which a whitespace marker follows another character, so no merge ever crosses
the border in front of a marker run. A text therefore splits into marked words that are segmented apart: each
distinct one is segmented and decoded by the library once per worker, and its ids are joined back by position. The
table lives as long as the worker; it has two generations, so that words that come again and again stay in it. (A table
over the whole corpus would shuffle every occurrence of a word, several times the input.)
The border rule is verified against the vocabulary when the model is loaded.

Null texts are empty texts; an empty text has no ids and decodes to the empty text. A text of any length is
processed whole; ties and repeated rows need no care as rows are independent.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame

from .common import map_texts, text_rows

#: The table is started anew when it holds so many words; bounds a worker's memory.
TABLE_WORDS = 200_000
MARK = "▁"
_CHUNKS = re.compile(" +[^ ]*")


class ChunkTable:
    """Ids and decoded form of marked words; ``word`` is a chunk without its first marker."""

    def __init__(self, model_path: str, limit: int = TABLE_WORDS) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = (self.model.id_to_piece(i) for i in range(self.model.vocab_size()))
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("pieces of this model cross whitespace markers")
        self.limit, self.ids, self.text, self.joined = limit, {}, {}, {}
        self.old: tuple[dict, dict, dict] = ({}, {}, {})
        self.mark_id = self.model.piece_to_id(MARK)

    def chunks(self, text: str) -> list[str]:
        text = text.replace(MARK, " ")
        if not text:
            return []
        if text[0] != " " and "  " not in text:
            return text.split(" ")
        return [c[1:] for c in _CHUNKS.findall(" " + text)]

    def learn(self, words: set[str]) -> None:
        """Segment the words that the table lacks."""
        if len(self.ids) > self.limit // 2:
            self.old, self.ids, self.text, self.joined = (self.ids, self.text, self.joined), {}, {}, {}
        old, old_text, old_joined = self.old
        new = []
        for w in words:
            if w not in self.ids:
                if w in old:
                    self.ids[w], self.text[w], self.joined[w] = old[w], old_text[w], old_joined[w]
                else:
                    new.append(w)
        for word, ids in zip(new, self.model.encode(new, num_threads=1) if new else []):
            ids = ids if word else [self.mark_id]
            self.ids[word] = ids
            self.text[word] = self.model.decode(ids) if word else ""
            self.joined[word] = ",".join(map(str, ids))

    def encode(self, text: str) -> list[int]:
        words = self.chunks(text)
        self.learn(set(words))
        return [i for w in words for i in self.ids[w]]


_LOADED: dict[str, ChunkTable] = {}


def chunk_table(model_path: str) -> ChunkTable:
    """The table of this worker."""
    if model_path not in _LOADED:
        _LOADED.clear()
        _LOADED[model_path] = ChunkTable(model_path)
    return _LOADED[model_path]


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids array<int>, decoded string)`` for every text."""

    def kernel():
        table = chunk_table(model_path)

        def apply(ids, texts):
            split = [table.chunks(t) for t in texts]
            table.learn({w for words in split for w in words})
            return {
                "doc_id": ids,
                "ids": [[i for w in words for i in table.ids[w]] for words in split],
                "decoded": [" ".join([table.text[w] for w in words]) for words in split],
            }

        return apply

    return map_texts(text_rows(docs, id_col, text_col), kernel, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Like :func:`encode_decode`, with digests in place of ids and text; nothing large leaves the worker."""

    def kernel():
        table = chunk_table(model_path)

        def apply(ids, texts):
            split = [table.chunks(t) for t in texts]
            table.learn(set().union(*split))
            n, sha, decoded = [], [], []
            joined, text = table.joined.__getitem__, table.text.__getitem__
            for own in split:
                s = ",".join(map(joined, own))
                n.append(s.count(",") + 1 if s else 0)
                sha.append(hashlib.sha256(s.encode()).hexdigest())
                decoded.append(hashlib.sha256(" ".join(map(text, own)).encode()).hexdigest())
            return {"doc_id": ids, "n_tokens": n, "ids_sha256": sha, "decoded_sha256": decoded}

        return apply

    return map_texts(text_rows(docs, id_col, text_col), kernel, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Hashes of words and of word shingles, computed for many texts at once.

A word is a run of bytes other than ASCII blanks. Its hash is a polynomial over its bytes' random values modulo
2 ** 64, finished by a mixing step; prefix sums give the hashes of all words of a block of bytes without a loop
over words. Blocks are cut at blanks, so memory follows the block (or the longest word), not the text.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
#: A random odd value for each byte.
VALUES = np.random.default_rng(20).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)

_POWERS: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and those of its inverse, ``n`` or more of each; kept for the next call up to a few blocks."""
    if len(_POWERS.get("up", ())) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _POWERS[name] = np.multiply.accumulate(p)
    up, down = _POWERS["up"], _POWERS["down"]
    if len(up) > 4 * BLOCK:
        _POWERS.clear()
    return up, down


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _block_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words of bytes that begin and end with a blank."""
    blank = BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    start, end = edge[::2], edge[1::2]
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(up[: len(data)] * VALUES[data], out=total[1:])
    return start, mixed((total[end] - total[start]) * down[start])


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``(number of words of each text, hashes of all words)``."""
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    starts, hashes, at = [], [], 0
    while at < len(data) - 1:
        end = min(at + BLOCK, len(data) - 1)
        while not BLANK[data[end]]:  # on to the next blank
            stop = min(end + 4096, len(data))
            ahead = np.flatnonzero(BLANK[data[end:stop]])
            end = end + int(ahead[0]) if len(ahead) else stop
        s, h = _block_words(data[at : end + 1])
        starts.append(s + at)
        hashes.append(h)
        at = end
    start = np.concatenate(starts)
    begins = np.cumsum([1, *(len(r) + 1 for r in raws)])
    return np.diff(np.searchsorted(start, begins)), np.concatenate(hashes)


def _combined(h: np.ndarray, k: int) -> np.ndarray:
    x = np.full(len(h) - k + 1, np.uint64(k))
    for i in range(k):
        x += h[i : len(h) - k + 1 + i] * _C[i % 7] + np.uint64(i // 7)
    return mixed(x)


def shingle_sets(texts: list[str], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word k-shingles of each text (A-Z lower-cased, ASCII white space); a
    text of fewer words has its whole sequence, one without words nothing."""
    n, h = words_of([t.encode().lower() for t in texts])
    all_ = _combined(h, k) if len(h) >= k else h[:0]
    out, at = [], 0
    for m in n.tolist():
        if m >= k:
            s = np.sort(all_[at : at + m - k + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            out.append(s[new])
        else:
            out.append(_combined(h[at : at + m], m) if m else h[:0])
        at += m
    return out

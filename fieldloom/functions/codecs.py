"""Payload codecs: PNG, NPY, and COCO run-length strings. ``images`` has the other image formats."""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np

_PNG = b"\x89PNG\r\n\x1a\n"
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def png_decode(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, c) samples in file order, uint8, or uint16 of 16-bit files; a palette gives colours (with alpha, if it has any). Not interlaced."""
    if data[:8] != _PNG:
        raise ValueError("not a PNG image")
    at, packed, head, colours, alphas = 8, [], None, b"", b""
    while at < len(data):
        size, tag = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if tag == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif tag == b"PLTE":
            colours = body
        elif tag == b"tRNS":
            alphas = body
        elif tag == b"IDAT":
            packed.append(body)
        at += 12 + size
    if head is None or head[3] not in _CHANNELS or head[6]:
        raise ValueError("unsupported PNG: not interlaced only")
    w, h, depth, kind, c = *head[:4], _CHANNELS[head[3]]
    stride, back = -(-w * c * depth // 8), max(1, c * depth // 8)
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(h, 1 + stride)
    out = np.zeros((h, stride), np.uint8)
    above = np.zeros(stride, np.int32)
    for y in range(h):
        out[y] = above = _unfiltered(int(rows[y, 0]), rows[y, 1:].astype(np.int32), above, back)
    if depth == 16:
        out = out.view(">u2").astype(np.uint16)
    elif depth < 8:
        out = (out[:, :, None] >> np.arange(8 - depth, -1, -depth) & (1 << depth) - 1).reshape(h, -1)[:, :w].astype(np.uint8)
    if kind == 3:
        table = np.frombuffer(colours, np.uint8).reshape(-1, 3)
        if alphas:
            table = np.concatenate([table, np.full((len(table), 1), 255, np.uint8)], axis=1)
            table[: len(alphas), 3] = np.frombuffer(alphas, np.uint8)
        return table[out]
    if depth < 8:
        out = out * np.uint8(255 // ((1 << depth) - 1))
    return out.reshape(h, w) if c == 1 else out.reshape(h, w, c)


def _unfiltered(kind: int, line: np.ndarray, above: np.ndarray, back: int) -> np.ndarray:
    """A row of bytes from its differences to bytes on the left (``back`` away), above, or both."""
    if kind == 1:
        for k in range(back):
            line[k::back] = np.cumsum(line[k::back]) & 255
    elif kind == 2:
        line = (line + above) & 255
    elif kind in (3, 4):
        for i in range(len(line)):
            a, b, d = (line[i - back] if i >= back else 0), above[i], (above[i - back] if i >= back else 0)
            if kind == 3:
                p = (a + b) // 2
            else:
                e = a + b - d
                p = min((abs(e - a), 0, a), (abs(e - b), 1, b), (abs(e - d), 2, d))[2]
            line[i] = (line[i] + p) & 255
    return line


def png_encode(a: np.ndarray) -> bytes:
    """8-bit samples (h, w) or (h, w, 3 or 4)."""
    a = np.ascontiguousarray(a, np.uint8)
    h, w = a.shape[:2]
    kind = 0 if a.ndim == 2 else {3: 2, 4: 6}[a.shape[2]]
    rows = np.concatenate([np.zeros((h, 1), np.uint8), a.reshape(h, -1)], axis=1)
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return _PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes())) + chunk(b"IEND", b"")


def npy_decode(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def npy_encode(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def rle_counts(mask: np.ndarray) -> list[int]:
    """Column-major run lengths, zeros first."""
    bits = (np.asarray(mask) > 0).ravel(order="F").astype(np.int8)
    cuts = np.flatnonzero(np.diff(bits, prepend=0))
    return np.diff([0, *cuts, len(bits)]).tolist()


def rle_mask(counts: list[int], h: int, w: int) -> np.ndarray:
    values = np.arange(len(counts)) % 2
    return np.repeat(values, counts).astype(np.uint8).reshape((h, w), order="F")


def coco_string(counts: list[int]) -> str:
    """Counts as the COCO text form: differences to the count two before, 5 bits a character, lowest first."""
    out = []
    for i, n in enumerate(counts):
        v, more = n - (counts[i - 2] if i > 2 else 0), True
        while more:
            part = v & 31
            v >>= 5
            more = v != (-1 if part & 16 else 0)
            out.append(chr((part | 32 if more else part) + 48))
    return "".join(out)


def coco_counts(text: str) -> list[int]:
    counts: list[int] = []
    at = 0
    while at < len(text):
        v = shift = 0
        while True:
            c = ord(text[at]) - 48
            v |= (c & 31) << shift
            at += 1
            shift += 5
            if not c & 32:
                if c & 16:
                    v |= -1 << shift
                break
        counts.append(v + (counts[-2] if len(counts) > 2 else 0))
    return counts

"""Baseline JPEG images: one or three components, Huffman coded, in one scan."""

from __future__ import annotations

import heapq
import re
import struct
from collections import Counter

import numpy as np

#: Basis of the cosine transform: row k is the k-th frequency over eight samples.
COSINES = np.array([[(0.5**0.5 if k == 0 else 1.0) / 2 * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
#: Row-major place of each coefficient in the order of storage: along the diagonals, upwards on even ones.
ZIGZAG = np.array([y * 8 + x for y, x in sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[1] if sum(p) % 2 == 0 else p[0]))])
#: RGB to brightness and colour differences, and back (fixed values of the format).
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])
TO_RGB = np.array([[1, 0, 1.402], [1, -0.344136, -0.714136], [1, 1.772, 0]])


def segments(image: bytes) -> tuple[dict[int, list[bytes]], bytes]:
    """Bodies of the marker segments by marker, and the bytes of the scan as they are stored."""
    if image[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG image")
    at, found = 2, {}
    while True:
        while image[at : at + 2] == b"\xff\xff":
            at += 1
        marker, size = image[at + 1], struct.unpack_from(">H", image, at + 2)[0]
        found.setdefault(marker, []).append(image[at + 4 : at + 2 + size])
        at += 2 + size
        if marker == 0xDA:
            end = image.rfind(b"\xff\xd9", at)
            return found, image[at : end if end >= 0 else len(image)]


def codes(lengths: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """``(symbol, code, length)`` of (symbol, length), shortest first: each code follows the one before."""
    out, code, before = [], 0, 0
    for symbol, n in lengths:
        code <<= n - before
        out.append((symbol, code, n))
        code, before = code + 1, n
    return out


def _windows(bodies: list[bytes]) -> dict[int, tuple[list[int], list[int]]]:
    """Huffman tables by class and id: length (0: none) and symbol of each 16-bit window."""
    out = {}
    for body in bodies:
        while body:
            counts = body[1:17]
            symbols = body[17 : 17 + sum(counts)]
            lengths = np.repeat(np.arange(1, 17), list(counts)).tolist()
            length, symbol = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
            for s, code, n in codes(list(zip(symbols, lengths))):
                length[code << 16 - n : code + 1 << 16 - n], symbol[code << 16 - n : code + 1 << 16 - n] = n, s
            out[body[0]] = (length.tolist(), symbol.tolist())
            body = body[17 + sum(counts) :]
    return out


class _Scan:
    """Coefficients of one restart interval; zeros follow its end."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data + bytes(16), 0

    def peek(self, n: int) -> int:
        a = self.at >> 3
        return int.from_bytes(self.data[a : a + 4], "big") >> 32 - n - (self.at & 7) & (1 << n) - 1

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        window = self.peek(16)
        n = table[0][window]
        if not n:
            raise ValueError("a code that is in no Huffman table")
        self.at += n
        return table[1][window]

    def value(self, size: int) -> int:
        if not size:
            return 0
        v = self.peek(size)
        self.at = min(self.at + size, 8 * len(self.data) - 128)
        return v if v >> size - 1 else v - (1 << size) + 1

    def block(self, dc, ac, before: int, out: np.ndarray) -> int:
        out[0] = before = before + self.value(self.symbol(dc))
        k = 1
        while k < 64:
            run, size = divmod(self.symbol(ac), 16)
            if not size and run < 15:
                break
            k += run
            if size and k < 64:
                out[k] = self.value(size)
            k += 1
        return before


def planes(image: bytes) -> list[np.ndarray]:
    """Sample planes of an image, all at full size; coarser ones are repeated."""
    found, scan = segments(image)
    frame = (found.get(0xC0) or found.get(0xC1) or [None])[0]
    if frame is None:
        raise ValueError("only baseline JPEG images can be read")
    if 0xC4 not in found:
        raise ValueError("the frame has no Huffman tables of its own")
    precision, height, width, n = struct.unpack_from(">BHHB", frame)
    if precision != 8 or n not in (1, 3):
        raise ValueError("only 8-bit images of one or three components can be read")
    body = found[0xDA][0]
    if body[0] != n:
        raise ValueError("only images of one scan can be read")
    quant = {}
    for q in found[0xDB]:
        while q:
            size = 129 if q[0] >> 4 else 65
            quant[q[0] & 15] = np.frombuffer(q[1:size], ">u2" if q[0] >> 4 else np.uint8).astype(np.int32)
            q = q[size:]
    tables, chosen = _windows(found[0xC4]), {body[1 + 2 * i]: divmod(body[2 + 2 * i], 16) for i in range(n)}
    parts = [(frame[6 + 3 * i], *(divmod(frame[7 + 3 * i], 16) if n > 1 else (1, 1)), frame[8 + 3 * i]) for i in range(n)]
    across, down = max(h for _, h, _, _ in parts), max(v for _, _, v, _ in parts)
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    every = struct.unpack(">H", found[0xDD][0][:2])[0] if 0xDD in found else 0
    coded = [np.zeros((rows * v, columns * h, 64), np.int32) for _, h, v, _ in parts]
    intervals = iter(re.split(rb"\xff[\xd0-\xd7]", scan))
    for mcu in range(rows * columns):
        if mcu == 0 or every and mcu % every == 0:
            bits, before = _Scan(next(intervals, b"").replace(b"\xff\x00", b"\xff")), [0] * n
        y, x = divmod(mcu, columns)
        for i, (name, h, v, _) in enumerate(parts):
            dc, ac = chosen[name]
            for k in range(h * v):
                before[i] = bits.block(tables[dc], tables[0x10 | ac], before[i], coded[i][y * v + k // h, x * h + k % h])
    out = []
    for (_, h, v, q), own in zip(parts, coded):
        natural = np.zeros(own.shape, float)
        natural[..., ZIGZAG] = own * quant[q]
        blocks = np.einsum("ki,yxkl,lj->yixj", COSINES, natural.reshape(*own.shape[:2], 8, 8), COSINES)
        plane = np.clip(np.rint(blocks.reshape(own.shape[0] * 8, -1) + 128), 0, 255)
        out.append(plane.repeat(down // v, axis=0).repeat(across // h, axis=1)[:height, :width])
    return out


def decode(image: bytes) -> np.ndarray:
    """(h, w) grey or (h, w, 3) RGB samples."""
    found = planes(image)
    if len(found) == 1:
        return found[0].astype(np.uint8)
    ycc = np.stack(found, axis=2) - [0, 128, 128]
    return np.clip(np.rint(ycc @ TO_RGB.T), 0, 255).astype(np.uint8)


def _lengths(counts: Counter) -> list[tuple[int, int]]:
    """Huffman code lengths, 16 at most, shortest first; no code is all ones."""
    nodes = [(n, i, (s,)) for i, (s, n) in enumerate(sorted(counts.items()))] + [(0, 1 << 20, (-1,))]  # -1 takes the code of ones
    depth = Counter()
    heapq.heapify(nodes)
    while len(nodes) > 1:
        a, b = heapq.heappop(nodes), heapq.heappop(nodes)
        depth.update(a[2] + b[2])
        heapq.heappush(nodes, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    number = Counter(depth.values())
    for n in range(max(number), 16, -1):  # two of the longest move up, beside one that is split
        while number[n]:
            shorter = next(m for m in range(n - 2, 0, -1) if number[m])
            number[n] -= 2
            number[n - 1] += 1
            number[shorter] -= 1
            number[shorter + 1] += 2
    order = sorted((s for s in depth if s >= 0), key=lambda s: (depth[s], s))
    sizes = sorted(number.elements())[:-1]
    return list(zip(order, sizes))


def encode(a: np.ndarray, quality: int = 95) -> bytes:
    """A baseline image of (h, w) grey or (h, w, 3) RGB samples without subsampling; at 100 all steps are 1."""
    a = np.asarray(a, np.float64)
    if a.ndim == 3 and a.shape[2] != 3:
        raise ValueError("a JPEG image has one or three channels")
    h, w = a.shape[:2]
    if not 0 < h < 1 << 16 or not 0 < w < 1 << 16:
        raise ValueError("a JPEG image has 1 to 65,535 rows and columns")
    parts = [a] if a.ndim == 2 else list(np.moveaxis(a @ TO_YCC.T + [0, 128, 128], 2, 0))
    step = np.add.outer(np.arange(8), np.arange(8)).ravel()
    quant = np.clip(np.rint(1 + (100 - quality) / 25 * (1 + step)), 1, 255)
    coded = []
    for p in parts:
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        blocks = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8)
        freq = np.einsum("ki,yixj,lj->yxkl", COSINES, blocks, COSINES).reshape(-1, 64)
        coded.append(np.rint(freq / quant).astype(np.int64)[:, ZIGZAG])
    symbols: list[tuple[int, int, int, int]] = []  # class, symbol, size, bits
    before = [0] * len(coded)
    for i in range(len(coded[0])):
        for c, own in enumerate(coded):
            row = own[i]
            for k, v in [(0, int(row[0]) - before[c]), *((int(k), int(row[k])) for k in np.flatnonzero(row[1:]) + 1)]:
                size = abs(v).bit_length()
                bits = v if v >= 0 else v + (1 << size) - 1
                if k == 0:
                    symbols.append((0, size, size, bits))
                    last = 0
                    continue
                run = k - last - 1
                symbols += [(1, 0xF0, 0, 0)] * (run // 16)
                symbols.append((1, run % 16 << 4 | size, size, bits))
                last = k
            before[c] = int(row[0])
            if last < 63:
                symbols.append((1, 0, 0, 0))
    tables = [_lengths(Counter(s[1] for s in symbols if s[0] == kind)) if any(s[0] == kind for s in symbols) else [(0, 1)] for kind in (0, 1)]
    words = [{s: (code, n) for s, code, n in codes(t)} for t in tables]
    held = n = 0
    scan = bytearray()
    for kind, symbol, size, bits in symbols:
        code, length = words[kind][symbol]
        held, n = held << length + size | code << size | bits, n + length + size
        while n >= 8:
            n -= 8
            byte = held >> n & 255
            scan.append(byte)
            if byte == 255:
                scan.append(0)
            held &= (1 << n) - 1
    if n:
        byte = (held << 8 - n | (1 << 8 - n) - 1) & 255
        scan += bytes([byte, 0] if byte == 255 else [byte])
    part = lambda tag, body: b"\xff" + bytes([tag]) + struct.pack(">H", len(body) + 2) + body
    dht = lambda kind, t: part(0xC4, bytes([kind << 4]) + bytes(sum(x == k for _, x in t) for k in range(1, 17)) + bytes(s for s, _ in t))
    count = len(parts)
    return b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"), part(0xDB, b"\0" + quant[ZIGZAG].astype(np.uint8).tobytes()),
        part(0xC0, struct.pack(">BHHB", 8, h, w, count) + b"".join(bytes([i + 1, 0x11, 0]) for i in range(count))), dht(0, tables[0]), dht(1, tables[1]),
        part(0xDA, bytes([count]) + b"".join(bytes([i + 1, 0]) for i in range(count)) + b"\0\x3f\0"), bytes(scan), b"\xff\xd9",
    ])

"""Image files of any listed format to samples and back: PNG, baseline JPEG, BMP, and TIFF in strips.

Samples are (h, w) or (h, w, c) in the order red, green, blue, alpha, whatever the file's own order is; palettes are looked up.
WebP, tiles, interlaced PNG and progressive JPEG are refused with an error.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np

from . import codecs, jpeg


def _grey(a: np.ndarray) -> np.ndarray:
    """A colour raster whose channels all agree as one channel."""
    return a[..., 0] if a.ndim == 3 and a.shape[2] == 3 and (a == a[..., :1]).all() else a


def _unpacked(rows: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Samples of ``bits`` bits, the first in the highest, of rows of bytes."""
    if bits == 8:
        return rows[:, :width]
    shifts = np.arange(8 - bits, -1, -bits)
    return (rows[:, :, None] >> shifts & (1 << bits) - 1).reshape(len(rows), -1)[:, :width].astype(np.uint8)


# --- BMP -------------------------------------------------------------------------------------------------------------


def bmp_decode(data: bytes) -> np.ndarray:
    """Uncompressed bitmaps of 1, 4, 8, 24 or 32 bits, either way up. A grey palette gives one channel; the fourth byte is alpha only where masks say so."""
    start, size, w, h, _, bits, packed = struct.unpack_from("<10xIIiiHHI", data)
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or packed == 3 and bits != 32:
        raise ValueError("unsupported BMP: uncompressed rows of 1, 4, 8, 24 or 32 bits only")
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits <= 8:
        used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
        return _grey(palette[_unpacked(rows, w, bits)])
    if packed == 3:
        masks = struct.unpack_from("<3I", data, 54) + (struct.unpack_from("<I", data, 66) if size >= 56 else (0,))
        word = rows.view("<u4")[:, :w]
        return np.stack([word >> (m & -m).bit_length() - 1 & 255 for m in masks if m], axis=2).astype(np.uint8)
    return np.ascontiguousarray(rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[..., 2::-1])


def bmp_encode(a: np.ndarray) -> bytes:
    """Grey as 8 bits with a palette, RGB as 24 bits, RGBA as 32 bits with masks; rows from below."""
    a = np.asarray(a, np.uint8)
    h, w = a.shape[:2]
    c = 1 if a.ndim == 2 else a.shape[2]
    if c not in (1, 3, 4):
        raise ValueError("a bitmap has 1, 3 or 4 channels")
    order = a if c == 1 else a[..., [2, 1, 0] if c == 3 else [2, 1, 0, 3]]
    rows = np.pad(order.reshape(h, w * c), ((0, 0), (0, -(w * c) % 4)))[::-1]
    extra = b"".join(bytes([i, i, i, 0]) for i in range(256)) if c == 1 else struct.pack("<4I", 255 << 16, 255 << 8, 255, 255 << 24) if c == 4 else b""
    size = 56 if c == 4 else 40
    head = struct.pack("<IiiHHIIiiII", size, w, h, 1, 8 * c, 3 if c == 4 else 0, rows.size, 2835, 2835, 256 if c == 1 else 0, 0)
    start = 14 + len(head) + len(extra)
    return b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + head + extra + rows.tobytes()


# --- TIFF ------------------------------------------------------------------------------------------------------------

#: Numbers of fields and compressions, and sizes of the types of values (fixed values of the format).
WIDTH, HEIGHT, BITS, PACKED, KIND, OFFSETS, SAMPLES, PER_STRIP, COUNTS, PLANAR, PREDICTOR, COLOURS, TILES = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 320, 322
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 2: "c", 3: "H", 4: "I"}


def packbits_decode(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more as counts, all else as it is."""
    out, at, plain = bytearray(), 0, 0

    def flush(end):
        for k in range(plain, end, 128):
            part = data[k : min(k + 128, end)]
            out.extend([len(part) - 1, *part])

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run > 2:
            flush(at)
            out.extend([257 - run, data[at]])
            plain = at + run
        at += run
    flush(len(data))
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, that widen one code early; 256 starts anew, 257 ends."""
    whole, total = int.from_bytes(data, "big"), 8 * len(data)
    out, table, width, at, last = [], [], 9, 0, b""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    while at + width <= total:
        at += width
        code = whole >> total - at & (1 << width) - 1 if total <= 4096 else int.from_bytes(data[(at - width) >> 3 : (at + 7) >> 3], "big") >> -at % 8 & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if not last:
            entry = table[code] if table else first[code]
            table = table or list(first)
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    bits, size, table, width, word = [], 258, {}, 9, b""
    bits.append((256, 9))
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in table:
            word = longer
            continue
        bits.append((table[word] if len(word) > 1 else word[0], width))
        table[longer] = size
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size == 4095:
            bits.append((256, 12))
            size, table, width = 258, {}, 9
        word = data[i : i + 1]
    if word:
        bits.append((table[word] if len(word) > 1 else word[0], width))
        width = 9 if size + 1 < 512 else 10 if size + 1 < 1024 else 11 if size + 1 < 2048 else 12
    bits.append((257, width))
    out, held, n = bytearray(), 0, 0
    for code, k in bits:
        held, n = held << k | code, n + k
        while n >= 8:
            n -= 8
            out.append(held >> n & 255)
            held &= (1 << n) - 1
    if n:
        out.append(held << 8 - n & 255)
    return bytes(out)


UNPACK: dict[int, Callable[[bytes], bytes]] = {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}


def tiff_decode(data: bytes) -> np.ndarray:
    """The first image of a file: strips of 1, 4, 8 or 16 bits, grey (either way), RGB, RGBA or palette, in one plane or several, with or without differences."""
    e = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(e + "I", data, 4)[0]
    tags = {}
    for i in range(struct.unpack_from(e + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(e + "HHI", data, at + 2 + 12 * i)
        if kind in TYPES:
            form = f"{e}{n}{TYPES[kind]}"
            place = at + 10 + 12 * i
            tags[tag] = struct.unpack_from(form, data, place if struct.calcsize(form) <= 4 else struct.unpack_from(e + "I", data, place)[0])
    get = lambda t, default: tags.get(t, (default,))[0]
    w, h, bits, c, packed = tags[WIDTH][0], tags[HEIGHT][0], get(BITS, 1), get(SAMPLES, 1), get(PACKED, NONE)
    if TILES in tags or OFFSETS not in tags or packed not in UNPACK or bits not in (1, 4, 8, 16) or len(set(tags.get(BITS, (1,)))) > 1 or c > 1 and bits < 8:
        raise ValueError("unsupported TIFF: strips of 1, 4, 8 or 16 bits, plain, LZW, Deflate or PackBits only")
    sizes = tags.get(COUNTS) or (len(data),)
    per, apart = min(get(PER_STRIP, h), h) or 1, get(PLANAR, 1) == 2
    inner = 1 if apart else c  # samples of a pixel that stand together
    stride = -(-w * inner * bits // 8)
    planes, rows = [], []
    for i, (start, size) in enumerate(zip(tags[OFFSETS], sizes)):
        n = min(per, h - i * per % (-(-h // per) * per))
        raw = UNPACK[packed](data[start : start + size])
        own = np.frombuffer(raw, np.uint8, n * stride).reshape(n, stride)
        own = own.view(e + "u2").astype(np.uint16) if bits == 16 else _unpacked(own, w * inner, bits)
        if get(PREDICTOR, 1) == 2:
            own = np.cumsum(own.reshape(n, w, inner), axis=1, dtype=own.dtype).reshape(n, -1)
        rows.append(own)
        if sum(len(r) for r in rows) == h:
            planes.append(np.concatenate(rows))
            rows = []
    a = np.stack(planes, axis=2) if apart else planes[0].reshape(h, w, c)
    a = a[..., 0] if c == 1 else a
    kind, top = get(KIND, 1), (1 << bits) - 1
    if kind == 3:
        table = np.array(tags[COLOURS], np.uint16).reshape(3, -1)
        return _grey((table.T[a] >> 8).astype(np.uint8))
    if kind == 0:
        a = top - a
    return (a * (255 // top)).astype(np.uint8) if bits < 8 else np.ascontiguousarray(a)


def tiff_encode(a: np.ndarray, packed: int = LZW, rows: int = 64, predictor: int = 1) -> bytes:
    """8-bit samples in strips of ``rows``, least byte first."""
    a = np.asarray(a, np.uint8)
    h, w = a.shape[:2]
    c = 1 if a.ndim == 2 else a.shape[2]
    if c not in (1, 3, 4):
        raise ValueError("1, 3 or 4 channels are written")
    body = a.reshape(h, w, c)
    if predictor == 2:
        body = np.concatenate([body[:, :1], np.diff(body, axis=1)], axis=1)
    pack = {NONE: bytes, LZW: lzw_encode, DEFLATE: zlib.compress, PACKBITS: packbits_encode}[packed]
    if packed == PACKBITS:  # no run crosses a row
        strips = [b"".join(pack(r.tobytes()) for r in body[y : y + rows]) for y in range(0, h, rows)]
    else:
        strips = [pack(body[y : y + rows].tobytes()) for y in range(0, h, rows)]
    starts = np.cumsum([8, *map(len, strips)])
    fields = [(WIDTH, 4, [w]), (HEIGHT, 4, [h]), (BITS, 3, [8] * c), (PACKED, 3, [packed]), (KIND, 3, [2 if c > 1 else 1]), (OFFSETS, 4, starts[:-1].tolist()), (SAMPLES, 3, [c]), (PER_STRIP, 4, [rows]), (COUNTS, 4, list(map(len, strips)))]
    fields += [(PLANAR, 3, [1])] + ([(PREDICTOR, 3, [2])] if predictor == 2 else []) + ([(338, 3, [2])] if c == 4 else [])
    at = int(starts[-1]) + int(starts[-1]) % 2
    tail, more = b"", at + 2 + 12 * len(fields) + 4
    entries = b""
    for tag, kind, values in fields:
        own = struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        if len(own) > 4:
            own, tail = struct.pack("<I", more + len(tail)), tail + own
        entries += struct.pack("<HHI", tag, kind, len(values)) + own.ljust(4, b"\0")
    return b"II*\0" + struct.pack("<I", at) + b"".join(strips) + b"\0" * (int(starts[-1]) % 2) + struct.pack("<H", len(fields)) + entries + bytes(4) + tail


# --- by format -------------------------------------------------------------------------------------------------------

DECODERS: list[tuple[bytes, Callable[[bytes], np.ndarray]]] = [(b"\x89PNG", codecs.png_decode), (b"\xff\xd8", jpeg.decode), (b"BM", bmp_decode), (b"II*\0", tiff_decode), (b"MM\0*", tiff_decode)]
ENCODERS: dict[str, Callable[[np.ndarray], bytes]] = {"png": codecs.png_encode, "jpg": jpeg.encode, "jpeg": jpeg.encode, "bmp": bmp_encode, "tif": tiff_encode, "tiff": tiff_encode}


def decode(data: bytes) -> np.ndarray:
    """Samples of a file, told by its first bytes."""
    for head, read in DECODERS:
        if data.startswith(head):
            return read(data)
    raise ValueError("unsupported image: PNG, JPEG, BMP and TIFF can be decoded")


def encode(a: np.ndarray, fmt: str) -> bytes:
    fmt = fmt.lstrip(".").lower()
    if fmt not in ENCODERS:
        raise ValueError(f"{fmt} images can't be written")
    return ENCODERS[fmt](a)

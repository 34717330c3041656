"""Image formats against encoders that are written here, from the formats' descriptions."""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pytest

from fieldloom.functions import codecs, images, jpeg
from fieldloom.sources import discover as S
from fieldloom.sources import sinks as K

R = np.random.default_rng(1)


def bits_of(values, n):
    """Bytes of numbers of n bits, highest first."""
    text = "".join(format(v, f"0{n}b") for v in values)
    text += "0" * (-len(text) % 8)
    return bytes(int(text[i : i + 8], 2) for i in range(0, len(text), 8))


# --- PNG and BMP -----------------------------------------------------------------------------------------------------


def png(w, h, depth, kind, rows, extra=b""):
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + struct.pack(">I", zlib.crc32(tag + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_png_kinds():
    chunk = lambda tag, body: struct.pack(">I", len(body)) + tag + body + b"\0\0\0\0"
    for depth in (1, 2, 4):
        v = R.integers(0, 1 << depth, (5, 11))
        got = images.decode(png(11, 5, depth, 0, [b"\0" + bits_of(r, depth) for r in v]))
        assert (got == v * (255 // ((1 << depth) - 1))).all()
        table = R.integers(0, 256, (1 << depth, 3)).astype(np.uint8)
        got = images.decode(png(11, 5, depth, 3, [b"\0" + bits_of(r, depth) for r in v], chunk(b"PLTE", table.tobytes())))
        assert (got == table[v]).all()
        got = images.decode(png(11, 5, depth, 3, [b"\0" + bits_of(r, depth) for r in v], chunk(b"PLTE", table.tobytes()) + chunk(b"tRNS", b"\x07")))
        assert got.shape == (5, 11, 4) and (got[..., 3] == np.where(v == 0, 7, 255)).all()
    v = R.integers(0, 1 << 16, (4, 3, 3))
    rows = [b"\0" + v[0].astype(">u2").tobytes()]
    for y in range(1, 4):  # filter 2: differences to the row above, by bytes
        a, b = np.frombuffer(v[y].astype(">u2").tobytes(), np.uint8), np.frombuffer(v[y - 1].astype(">u2").tobytes(), np.uint8)
        rows.append(b"\2" + (a - b).astype(np.uint8).tobytes())
    assert (images.decode(png(3, 4, 16, 2, rows)) == v).all()
    with pytest.raises(ValueError):
        images.decode(b"RIFF....WEBP")


def bmp(w, h, bits, rows, palette=b"", up=True, size=40):
    body = b"".join(r + bytes(-len(r) % 4) for r in (rows[::-1] if up else rows))
    head = struct.pack("<IiiHHIIiiII", size, w, h if up else -h, 1, bits, 0, len(body), 0, 0, len(palette) // 4, 0) + bytes(size - 40)
    start = 14 + len(head) + len(palette)
    return b"BM" + struct.pack("<IHHI", start + len(body), 0, 0, start) + head + palette + body


@pytest.mark.parametrize("up", [True, False])
def test_bmp_kinds(up):
    for bits in (1, 4, 8):
        v = R.integers(0, 1 << bits, (6, 13))
        table = R.integers(0, 256, (1 << bits, 3)).astype(np.uint8)
        data = bmp(13, 6, bits, [bits_of(r, bits) for r in v], b"".join(bytes([*c[::-1], 0]) for c in table), up, 40 if up else 124)
        assert (images.decode(data) == table[v]).all()
    v = R.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    assert (images.decode(bmp(5, 6, 24, [r[:, ::-1].tobytes() for r in v], up=up)) == v).all()


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (9, 4, 3), (3, 5, 4)])
@pytest.mark.parametrize("fmt", ["png", "bmp", "tif"])
def test_round_trips(shape, fmt):
    a = R.integers(0, 256, shape).astype(np.uint8)
    assert (images.decode(images.encode(a, fmt)) == a).all()


# --- TIFF ------------------------------------------------------------------------------------------------------------


def tiff(fields, strips, e=">"):
    """Fields (tag, type, values); offsets and counts of strips are added."""
    body = b"".join(strips)
    starts = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    fields = sorted([*fields, (273, 4, starts), (279, 4, [len(s) for s in strips])])
    at = 8 + len(body)
    tail_at, entries, tail = at + 2 + 12 * len(fields) + 4, b"", b""
    for tag, kind, values in fields:
        own = struct.pack(f"{e}{len(values)}{'_BcHI'[kind]}", *values)
        if len(own) > 4:
            own, tail = struct.pack(e + "I", tail_at + len(tail)), tail + own
        entries += struct.pack(e + "HHI", tag, kind, len(values)) + own.ljust(4, b"\0")
    return (b"MM\0*" if e == ">" else b"II*\0") + struct.pack(e + "I", at) + body + struct.pack(e + "H", len(fields)) + entries + bytes(4) + tail


def codes_of(data):
    """LZW codes by the textbook: the longest known word, then one letter more becomes known."""
    words, word, out, width = {bytes([i]): i for i in range(256)}, b"", ["100000000"], 9
    count = 258
    for letter in data:
        longer = word + bytes([letter])
        if longer in words:
            word = longer
            continue
        out.append(format(words[word], f"0{width}b"))
        words[longer] = count
        count += 1
        width = max(9, (count).bit_length()) if count < 4096 else 12
        if count == 4094:
            out.append(format(256, "012b"))
            words, count, width = {bytes([i]): i for i in range(256)}, 258, 9
        word = bytes([letter])
    out += [format(words[word], f"0{width}b"), format(257, f"0{max(9, (count + 1).bit_length())}b")]
    text = "".join(out)
    return bytes(int(text[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(text), 8))


@pytest.mark.parametrize("e", ["<", ">"])
def test_tiff_kinds(e):
    v = R.integers(0, 256, (10, 6, 3)).astype(np.uint8)
    base = [(256, 3, [6]), (257, 3, [10])]
    rgb = [*base, (258, 3, [8] * 3), (262, 3, [2]), (277, 3, [3])]
    strips = [v[:4].tobytes(), v[4:8].tobytes(), v[8:].tobytes()]
    assert (images.decode(tiff([*rgb, (259, 3, [1]), (278, 3, [4])], strips, e)) == v).all()
    assert (images.decode(tiff([*rgb, (259, 3, [5]), (278, 3, [4])], [codes_of(s) for s in strips], e)) == v).all()
    d = np.concatenate([v[:, :1], v[:, 1:] - v[:, :-1]], axis=1)
    assert (images.decode(tiff([*rgb, (259, 3, [8]), (278, 3, [10]), (317, 3, [2])], [zlib.compress(d.tobytes())], e)) == v).all()
    apart = [v[a:b, :, c].tobytes() for c in range(3) for a, b in ((0, 4), (4, 8), (8, 10))]
    assert (images.decode(tiff([*rgb, (284, 3, [2]), (278, 3, [4])], apart, e)) == v).all()
    wide = R.integers(0, 1 << 16, (10, 6))
    assert (images.decode(tiff([*base, (258, 3, [16]), (262, 3, [1])], [wide.astype(e + "u2").tobytes()], e)) == wide).all()
    flags = R.integers(0, 2, (10, 6))
    assert (images.decode(tiff([*base, (258, 3, [1]), (262, 3, [0])], [b"".join(bits_of(r, 1) for r in flags)], e)) == 255 * (1 - flags)).all()
    table = R.integers(0, 256, (3, 16))
    four = R.integers(0, 16, (10, 6))
    got = images.decode(tiff([*base, (258, 3, [4]), (262, 3, [3]), (320, 3, (table * 257).ravel().tolist())], [b"".join(bits_of(r, 4) for r in four)], e))
    assert (got == table.T[four]).all()
    with pytest.raises(ValueError):
        images.decode(tiff([*base, (258, 3, [8]), (259, 3, [7])], [b""], e))


def test_lzw_and_packbits():
    assert images.lzw_decode(bits_of([256, 7, 258, 8, 8, 258, 6, 6, 257], 9)) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])  # the format's own example
    packed = bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")
    plain = bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22" + "AA" * 10)
    assert images.packbits_decode(packed) == plain and images.packbits_encode(plain) == packed
    for data in (b"", b"a", bytes(R.integers(0, 256, 30_000).astype(np.uint8)), b"ab" * 9_000, bytes(R.integers(0, 3, 40_000).astype(np.uint8)), b"\0" * 20_000):
        assert images.lzw_decode(images.lzw_encode(data)) == data
        assert images.packbits_decode(images.packbits_encode(data)) == data
        if data:
            assert images.lzw_decode(codes_of(data)) == data
    a = R.integers(0, 4, (130, 40, 3)).astype(np.uint8) * 60
    for packed in (images.NONE, images.LZW, images.DEFLATE, images.PACKBITS):
        for predictor in (1, 2):
            assert (images.decode(images.tiff_encode(a, packed, 64, predictor)) == a).all()


# --- JPEG ------------------------------------------------------------------------------------------------------------


def plain_jpeg(parts, quant, every=0):
    """Sample planes (all sizes multiples of 8 and of each other) by the formula of the transform, all codes of 8 bits."""
    across, down = max(p.shape[1] for p in parts), max(p.shape[0] for p in parts)
    h = [p.shape[1] * max(across // q.shape[1] for q in parts) // across for p in parts]
    v = [p.shape[0] * max(down // q.shape[0] for q in parts) // down for p in parts]
    zigzag = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda p: (sum(p), p[1] if sum(p) % 2 == 0 else p[0]))
    symbols = list(range(255))
    words = {s: format(s, "08b") for s in symbols}

    def coded(block):
        out = []
        for u, w in zigzag:
            c = sum(block[y][x] * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * w * math.pi / 16) for y in range(8) for x in range(8))
            out.append(round(c / 4 * (0.5**0.5 if u == 0 else 1) * (0.5**0.5 if w == 0 else 1) / quant))
        return out

    def number(value):
        n = abs(value).bit_length()
        return n, format(value if value > 0 else value + (1 << n) - 1, f"0{n}b") if n else ""

    text, before, chunks, mcu = "", [0] * len(parts), [], 0
    for y in range(down // 8 // max(v)):
        for x in range(across // 8 // max(h)):
            if every and mcu and mcu % every == 0:
                chunks.append(text)
                text, before = "", [0] * len(parts)
            for i, p in enumerate(parts):
                for a in range(v[i]):
                    for b in range(h[i]):
                        top, left = 8 * (y * v[i] + a), 8 * (x * h[i] + b)
                        c = coded([[float(p[top + k, left + m]) - 128 for m in range(8)] for k in range(8)])
                        n, own = number(c[0] - before[i])
                        text, before[i], run = text + words[n] + own, c[0], 0
                        for value in c[1:]:
                            if not value:
                                run += 1
                                continue
                            while run > 15:
                                text, run = text + words[0xF0], run - 16
                            n, own = number(value)
                            text, run = text + words[run << 4 | n] + own, 0
                        if run:
                            text += words[0]
            mcu += 1
    chunks.append(text)
    scan = b""
    for k, c in enumerate(chunks):
        c += "1" * (-len(c) % 8)
        scan += (bytes([255, 0xD0 + (k - 1) % 8]) if k else b"") + bytes(int(c[i : i + 8], 2) for i in range(0, len(c), 8)).replace(b"\xff", b"\xff\0")
    part = lambda tag, body: bytes([255, tag]) + struct.pack(">H", len(body) + 2) + body
    table = bytes([0] * 7 + [255] + [0] * 8) + bytes(symbols)
    n = len(parts)
    sof = struct.pack(">BHHB", 8, down, across, n) + b"".join(bytes([i + 1, h[i] << 4 | v[i], 0]) for i in range(n))
    sos = bytes([n]) + b"".join(bytes([i + 1, 0]) for i in range(n)) + bytes([0, 63, 0])
    return b"\xff\xd8" + part(0xDB, b"\0" + bytes([quant] * 64)) + part(0xC0, sof) + part(0xC4, b"\0" + table) + part(0xC4, b"\x10" + table) + (part(0xDD, struct.pack(">H", every)) if every else b"") + part(0xDA, sos) + scan + b"\xff\xd9"


def smooth(h, w):
    y, x = np.mgrid[:h, :w]
    return np.clip(128 + 90 * np.sin(y / 5 + R.random()) * np.cos(x / 7) + R.normal(size=(h, w)) * 3, 0, 255).round()


@pytest.mark.parametrize("every", [0, 2])
def test_jpeg_of_others(every):
    grey = smooth(16, 24)
    assert abs(images.decode(plain_jpeg([grey], 1, every)).astype(float) - grey).max() <= 1
    planes = [smooth(16, 32), smooth(8, 16), smooth(8, 16)]  # colours at half size both ways
    got = jpeg.planes(plain_jpeg(planes, 1, every))
    for a, b in zip(got, planes):
        n = a.shape[0] // b.shape[0]
        assert abs(a - b.repeat(n, axis=0).repeat(n, axis=1)).max() <= 1


@pytest.mark.parametrize("shape", [(1, 1), (8, 8), (19, 33), (40, 17, 3)])
def test_jpeg_round_trip(shape):
    a = np.stack([smooth(*shape[:2]) for _ in range(3)], axis=2) if len(shape) == 3 else smooth(*shape)
    last = 0
    for quality, most in ((100, 3), (90, 12), (50, 40)):
        data = jpeg.encode(a, quality)
        assert abs(images.decode(data).astype(float) - a).max() <= most
        assert not last or len(data) <= last
        last = len(data)
    noise = R.integers(0, 256, shape)
    assert abs(images.decode(jpeg.encode(noise, 100)).astype(int) - noise).max() <= 4


def test_jpeg_long_codes():
    """Counts that would need codes of over 16 bits."""
    from collections import Counter

    counts = Counter({s: 2**s for s in range(40)})
    lengths = jpeg._lengths(counts)
    assert {s for s, _ in lengths} == set(range(40)) and max(n for _, n in lengths) <= 16
    words = [format(c, f"0{n}b") for _, c, n in jpeg.codes(lengths)]
    assert not any(a != b and b.startswith(a) for a in words for b in words) and all("0" in w for w in words)
    with pytest.raises(ValueError):
        jpeg.decode(jpeg.encode(smooth(8, 8)).replace(b"\xff\xc0", b"\xff\xc2"))


# --- tables ----------------------------------------------------------------------------------------------------------


def test_files_of_all_formats(spark, tmp_path):
    a = R.integers(0, 256, (6, 5, 3)).astype(np.uint8)
    for i, fmt in enumerate(("png", "bmp", "tif", "jpg")):
        (tmp_path / f"{i}.{fmt}").write_bytes(images.encode(a, fmt))
    rows = {r.path.rpartition(".")[2]: r for r in S.read_images(spark, str(tmp_path)).collect()}
    assert {k for k, r in rows.items() if list(r.data) == a.ravel().tolist()} >= {"png", "bmp", "tif"} and rows["jpg"].channels == 3
    maps = {r.path.rpartition(".")[2]: r for r in S.read_segmaps(spark, str(tmp_path)).collect()}
    assert list(maps["bmp"].data) == a[..., 0].ravel().tolist() and maps["bmp"].channels == 1
    table = spark.createDataFrame([("x", 6, 5, 3, a.ravel().tolist()), ("y", 6, 5, 1, a[..., 0].ravel().tolist())], "stem string, h int, w int, channels int, data array<int>")
    for fmt in ("tif", ".BMP", "png"):
        got = {r.stem: list(r.data) for r in S.decoded_images(K.encoded(table, fmt), "stem").collect()}
        assert got == {"x": a.ravel().tolist(), "y": a[..., 0].ravel().tolist()}
    assert codecs.png_decode(images.encode(a, "png")).tolist() == a.tolist()
    with pytest.raises(Exception, match="webp"):
        K.encoded(table, "webp").collect()
